"""An investigator that lets a language model choose recipes, step by step, and keeps only findings that cite evidence."""

from __future__ import annotations

import json
import re
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from sparkeda.api import Dataset, load
from sparkeda.model import AnalysisResult, Evidence, Finding, Warning_, sort_findings
from sparkeda.privacy import PrivacyPolicy

TOOLS = {
    "profile_dataset": "profile", "discover_schema": "discover_schema", "detect_anomalies": "anomaly_detection", "assess_classification": "classification", "assess_regression": "regression",
    "analyze_time_series": "time_series", "assess_clustering": "clustering",
}


@dataclass(frozen=True)
class Decision:
    tool: str | None
    arguments: dict = field(default_factory=dict)
    findings: tuple[dict, ...] = ()


def parse_decision(text: str) -> Decision:
    """The first JSON object of an answer; anything else is a decision to stop."""
    for at in (m.start() for m in re.finditer(r"\{", text)):
        try:
            got, _ = json.JSONDecoder().raw_decode(text[at:])
        except ValueError:
            continue
        if isinstance(got, dict):
            tool = got.get("tool")
            args = got.get("arguments")
            found = got.get("findings")
            return Decision(tool if isinstance(tool, str) and tool not in ("", "finish") else None, args if isinstance(args, dict) else {}, tuple(f for f in found if isinstance(f, dict)) if isinstance(found, list) else ())
    return Decision(None)


class Provider(ABC):
    @abstractmethod
    def decide(self, state: dict) -> str:
        """An answer with a JSON object {tool, arguments} or {findings}."""


class ScriptedProvider(Provider):
    """Answers given beforehand; by default one profile and then the end."""

    def __init__(self, answers: list[str] | None = None):
        self.answers = list(answers) if answers is not None else ['{"tool": "profile_dataset"}', '{"tool": "finish"}']

    def decide(self, state: dict) -> str:
        return self.answers.pop(0) if self.answers else '{"tool": "finish"}'


def tool_registry(data: Dataset, policy: PrivacyPolicy) -> dict[str, Callable[..., Any]]:
    """list_tables, describe_table, and one tool for each recipe."""
    def describe(table: str) -> list[dict]:
        columns = next((t["columns"] for t in data.catalog() if t["table"] == table), [])
        return [d for c in columns if (d := policy.describe(c["column"], c)) is not None]

    tools: dict[str, Callable[..., Any]] = {"list_tables": lambda: [{k: t[k] for k in ("table", "n_rows", "n_columns")} for t in data.catalog()], "describe_table": describe}
    for name, goal in TOOLS.items():
        tools[name] = lambda goal=goal, **kw: data.analyze(goal, **kw)
    return tools


class Investigator:
    def __init__(self, source: Any, provider: Provider | None = None, privacy: PrivacyPolicy | None = None, callbacks=(), max_steps: int = 8):
        self.data, self.provider, self.policy = load(source), provider or ScriptedProvider(), privacy or PrivacyPolicy()
        self.callbacks, self.max_steps, self.goal = callbacks, max_steps, ""

    def start(self, goal: str, context: dict | None = None) -> Investigator:
        self.goal, self.context = goal, context or {}
        return self

    def run(self) -> AnalysisResult:
        """Ask, run the tool, tell what came out (ids and titles, no values), until the model stops or the steps are used up."""
        tools, out = tool_registry(self.data, self.policy), AnalysisResult(goal=self.goal, catalog=self.data.catalog())
        state: dict = {"goal": self.goal, "tables": tools["list_tables"](), "seen": []}
        drafts: tuple[dict, ...] = ()
        for _ in range(self.max_steps):
            decision = parse_decision(self.provider.decide(state))
            if decision.tool is None:
                drafts = decision.findings
                break
            if decision.tool not in tools:
                state["seen"].append({"tool": decision.tool, "error": "unknown tool"})
                continue
            try:
                got = tools[decision.tool](**decision.arguments)
            except Exception as error:  # noqa: BLE001  told to the model
                state["seen"].append({"tool": decision.tool, "error": str(error)[:200]})
                continue
            if isinstance(got, AnalysisResult):
                out.evidence += [e for e in got.evidence if e.id not in {x.id for x in out.evidence}]
                out.findings += [f for f in got.findings if f not in out.findings]
                out.plan += got.plan
                got = {"status": got.status, "findings": [{"title": f.title, "severity": f.severity, "evidence_ids": list(f.evidence_ids)} for f in got.findings]}
            state["seen"].append({"tool": decision.tool, "result": got})
        else:
            out.warnings.append(Warning_("investigator_not_converged", f"no end after {self.max_steps} steps"))
        known = {e.id for e in out.evidence}
        for d in drafts:
            ids = tuple(i for i in d.get("evidence_ids", ()) if i in known)
            if ids and d.get("title"):  # what cites nothing known is left out
                out.findings.append(Finding(str(d["title"]), d.get("severity") if d.get("severity") in ("critical", "high", "medium", "low", "info") else "medium", ids, 0.6))
        out.findings = sort_findings(out.findings)
        out.status = "completed_with_warnings" if out.warnings else "completed"
        out.summary = interpret(out.findings, out.evidence)
        return out


def interpret(findings: list[Finding], evidence: list[Evidence]) -> str:
    """A short grounded account: the first findings with what they cite."""
    top = "; ".join(f"{f.title} ({f.severity})" for f in findings[:4])
    return f"{len(findings)} finding(s) from {len(evidence)} facts" + (f": {top}" if top else "")
