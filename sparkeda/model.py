"""Results: evidence, findings, artifacts, steps, and what an analysis returns."""

from __future__ import annotations

import datetime
import decimal
import enum
import hashlib
import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

SEVERITIES = ("critical", "high", "medium", "low", "info")
STATUSES = ("completed", "completed_with_warnings", "insufficient_evidence", "no_meaningful_structure", "failed")


class SparkEdaError(Exception):
    """Base of this library's errors."""


class DataLoadError(SparkEdaError):
    """A source could not be read."""


class UnsupportedSourceError(SparkEdaError):
    """A source of a kind that is not supported."""


class AnalysisError(SparkEdaError):
    """An analysis could not run at all."""


def stable(x: float) -> float:
    """Twelve significant digits: what reruns on other partitions agree on."""
    return float(f"{x:.12g}")


def jsonable(x: Any) -> Any:
    """Plain values: NaN and infinities become None, dates ISO text, floats stable."""
    if isinstance(x, enum.Enum):
        return jsonable(x.value)
    if is_dataclass(x) and not isinstance(x, type):
        return {f.name: jsonable(getattr(x, f.name)) for f in fields(x)}
    if hasattr(x, "asDict"):
        return jsonable(x.asDict(recursive=True))
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [jsonable(v) for v in (sorted(x, key=str) if isinstance(x, (set, frozenset)) else x)]
    if isinstance(x, bool) or x is None or isinstance(x, (str, int)):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return stable(x) if math.isfinite(x) else None
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    return jsonable(x.item()) if hasattr(x, "item") else str(x)


def content_id(prefix: str, *parts: Any) -> str:
    raw = json.dumps(jsonable(parts), sort_keys=True, separators=(",", ":"))
    return f"{prefix}_{hashlib.sha256(raw.encode()).hexdigest()[:16]}"


@dataclass(frozen=True)
class Evidence:
    """One measured fact. Its id is a hash of its content, so equal runs have equal ids; description and confidence are not in it."""

    kind: str
    value: Any
    table: str | None = None
    columns: tuple[str, ...] = ()
    method: str = "exact"
    assumptions: tuple[str, ...] = ()
    description: str = ""
    confidence: float = 1.0

    @property
    def id(self) -> str:
        return content_id("ev", self.kind, self.table, self.columns, self.value, self.method, self.assumptions)


@dataclass(frozen=True)
class Finding:
    title: str
    severity: str
    evidence_ids: tuple[str, ...]
    confidence: float = 1.0
    category: str = "quality_issue"
    summary: str = ""

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES or not self.evidence_ids:
            raise ValueError("a finding needs a known severity and the evidence it rests on")


def sort_findings(findings: Iterable[Finding]) -> list[Finding]:
    return sorted(findings, key=lambda f: (SEVERITIES.index(f.severity), -f.confidence, f.title))


def split_findings(findings: Iterable[Finding]) -> tuple[list[Finding], list[Finding]]:
    """(issues, observations)."""
    found = list(findings)
    return [f for f in found if f.category != "observation"], [f for f in found if f.category == "observation"]


@dataclass(frozen=True)
class Artifact:
    kind: str
    title: str
    rows: Any

    @property
    def id(self) -> str:
        return content_id("ar", self.kind, self.title, self.rows)


@dataclass(frozen=True)
class Step:
    """A recommended change; it is never carried out here."""

    operation: str
    risk: str
    table: str | None = None
    columns: tuple[str, ...] = ()
    evidence_ids: tuple[str, ...] = ()
    requires_approval: bool = True


@dataclass(frozen=True)
class Warning_:
    code: str
    message: str


@dataclass(frozen=True)
class SamplingRecord:
    operation: str
    source_rows: int
    sampled_rows: int
    strategy: str = "seeded hash order"
    seed: int = 42
    reason: str = ""


@dataclass
class AnalysisResult:
    goal: str
    status: str = "completed"
    summary: str = ""
    catalog: list[dict] = field(default_factory=list)
    findings: list[Finding] = field(default_factory=list)
    evidence: list[Evidence] = field(default_factory=list)
    artifacts: list[Artifact] = field(default_factory=list)
    assumptions: list[str] = field(default_factory=list)
    warnings: list[Warning_] = field(default_factory=list)
    failures: list[dict] = field(default_factory=list)
    sampling: list[SamplingRecord] = field(default_factory=list)
    plan: list[Step] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    @property
    def issues(self) -> list[Finding]:
        return split_findings(self.findings)[0]

    @property
    def observations(self) -> list[Finding]:
        return split_findings(self.findings)[1]

    def to_dict(self) -> dict:
        out = jsonable(self)
        for key in ("evidence", "artifacts"):
            for plain, item in zip(out[key], getattr(self, key), strict=True):
                plain["id"] = item.id
        return out

    def model_dump(self, mode: str = "json") -> dict:
        return self.to_dict()

    def to_json(self, path: str | Path, indent: int = 2) -> Path:
        Path(path).write_text(json.dumps(self.to_dict(), sort_keys=True, indent=indent))
        return Path(path)

    def to_html(self, path: str | Path, interactive: bool = False) -> Path:
        from sparkeda.report import render

        Path(path).write_text(render(self, interactive))
        return Path(path)

    def findings_frame(self, spark):
        rows = [(f.title, f.severity, f.category, f.confidence, list(f.evidence_ids)) for f in self.findings]
        return spark.createDataFrame(rows, "title string, severity string, category string, confidence double, evidence_ids array<string>")

    def evidence_frame(self, spark):
        rows = [(e.id, e.kind, e.table, list(e.columns), e.method, json.dumps(jsonable(e.value), sort_keys=True)) for e in self.evidence]
        return spark.createDataFrame(rows, "id string, kind string, `table` string, columns array<string>, method string, value string")


Callback = Callable[[dict], None]


def emit(callbacks: Iterable[Callback], kind: str, **details: Any) -> None:
    """Tell every observer; one that fails does not stop the run."""
    for callback in callbacks:
        try:
            callback({"kind": kind, **details})
        except Exception:  # noqa: BLE001, S110
            pass
