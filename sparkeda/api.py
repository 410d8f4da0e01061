"""Front door: load(), the recipes, and Dataset."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from sparkeda import recipes
from sparkeda.model import AnalysisError, AnalysisResult
from sparkeda.operators import catalog as cat
from sparkeda.sources.loaders import load_tables, session

GOALS = {
    "profile": "profile", "minimal_eda": "profile", "schema_discovery": "discover_schema", "discover_schema": "discover_schema", "anomaly_detection": "anomaly_detection", "anomaly": "anomaly_detection", "outlier_detection": "anomaly_detection",
    "classification": "classification", "classify": "classification", "regression": "regression", "regress": "regression", "time_series": "time_series", "timeseries": "time_series", "forecasting": "time_series",
    "clustering": "clustering", "cluster": "clustering", "segmentation": "clustering",
}


@dataclass(frozen=True)
class AnalysisContext:
    goal: str | None = None
    target: str | None = None
    entity_id: str | None = None
    timestamp: str | None = None
    groups: tuple[str, ...] = ()
    domain_notes: str = ""
    assumptions: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class AnalysisConfig:
    mode: str = "standard"
    sampling: str = "auto"
    random_seed: int = 42
    allow_insufficient_evidence: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("quick", "standard", "deep") or self.sampling not in ("auto", "disabled") or self.random_seed < 0:
            raise ValueError("mode is quick, standard or deep; sampling auto or disabled; random_seed not negative")


def _context(context: AnalysisContext | Mapping | None) -> AnalysisContext:
    return context if isinstance(context, AnalysisContext) else AnalysisContext(**(context or {}))


class Dataset:
    """Named tables and, once asked for, their catalogue."""

    def __init__(self, tables: dict[str, DataFrame]):
        self._tables, self._catalog = dict(tables), None

    @property
    def tables(self) -> Mapping[str, DataFrame]:
        return dict(self._tables)

    def catalog(self, refresh: bool = False) -> list[dict]:
        """Tables with their columns; computed once."""
        if self._catalog is None or refresh:
            self._catalog = [cat.table_catalog(df, name).first().asDict() | {"columns": [r.asDict() for r in cat.column_catalog(df, name).collect()]} for name, df in self._tables.items()]
        return self._catalog

    def analyze(self, goal: str, *, context: AnalysisContext | Mapping | None = None, config: AnalysisConfig | None = None, mode: str = "standard", sampling: str = "auto", random_seed: int = 42, allow_insufficient_evidence: bool = False, callbacks=(), **options: Any) -> AnalysisResult:
        name = GOALS.get(goal.lower().replace("-", "_"))
        if name is None:
            raise NotImplementedError(f"no recipe for {goal!r}")
        config = config or AnalysisConfig(mode, sampling, random_seed, allow_insufficient_evidence)
        recipe, known = recipes.RECIPES[name]
        wrong = sorted(set(options) - known)
        if wrong:
            raise TypeError(f"{name} has no option {', '.join(wrong)}")
        try:
            catalog = self.catalog()
        except Exception as error:
            raise AnalysisError(f"the catalogue failed: {error}") from error
        return recipe(self._tables, catalog, _context(context), config, callbacks, **options)

    def profile(self, **kw) -> AnalysisResult:
        return self.analyze("profile", **kw)

    minimal_eda = profile

    def discover_schema(self, **kw) -> AnalysisResult:
        return self.analyze("discover_schema", **kw)

    def anomaly_detection(self, **kw) -> AnalysisResult:
        return self.analyze("anomaly_detection", **kw)

    def classification(self, **kw) -> AnalysisResult:
        return self.analyze("classification", **kw)

    def regression(self, **kw) -> AnalysisResult:
        return self.analyze("regression", **kw)

    def time_series(self, **kw) -> AnalysisResult:
        return self.analyze("time_series", **kw)

    def clustering(self, **kw) -> AnalysisResult:
        return self.analyze("clustering", **kw)

    def compare(self, other: Dataset, *, context=None, callbacks=()) -> AnalysisResult:
        return recipes.compare(self._tables, self.catalog(), other._tables, other.catalog(), _context(context), callbacks)


_LOADER = ("recursive", "include", "exclude", "names", "read_options")


def load(source: Any, **loader: Any) -> Dataset:
    return source if isinstance(source, Dataset) else Dataset(load_tables(source, **loader))


def _run(goal: str, source: Any, kw: dict) -> AnalysisResult:
    loader = {k: kw.pop(k) for k in _LOADER if k in kw}
    return load(source, **loader).analyze(goal, **kw)


def profile(source: Any, **kw) -> AnalysisResult:
    return _run("profile", source, kw)


minimal_eda = profile


def discover_schema(source: Any, **kw) -> AnalysisResult:
    return _run("discover_schema", source, kw)


def anomaly_detection(source: Any, **kw) -> AnalysisResult:
    return _run("anomaly_detection", source, kw)


def classification(source: Any, **kw) -> AnalysisResult:
    return _run("classification", source, kw)


def regression(source: Any, **kw) -> AnalysisResult:
    return _run("regression", source, kw)


def time_series(source: Any, **kw) -> AnalysisResult:
    return _run("time_series", source, kw)


def clustering(source: Any, **kw) -> AnalysisResult:
    return _run("clustering", source, kw)


def compare_datasets(base: Any, comparator: Any, *, context=None, callbacks=(), **loader: Any) -> AnalysisResult:
    return load(base, **loader).compare(load(comparator, **loader), context=context, callbacks=callbacks)


def load_images(root: str) -> DataFrame:
    """Files of an image folder (every level), with label and split by folder names."""
    from sparkeda.operators.images import read_folder

    if "://" not in root and not Path(root).exists():
        raise FileNotFoundError(root)
    return read_folder(session(), root)


def profile_images(root: str, *, near_duplicate_threshold: int = 4, context=None, callbacks=()) -> AnalysisResult:
    return recipes.images(load_images(root), _context(context), callbacks, near_duplicate_threshold)
