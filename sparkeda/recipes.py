"""Recipes: operators in order, evidence from their small results, findings from the evidence.

Each optional stage is isolated: one that fails is recorded and the others go on.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.columns import columns_of, family
from sparkeda.functions.ordered import row_index
from sparkeda.model import AnalysisResult, Artifact, Evidence, Finding, SamplingRecord, Step, Warning_, emit, sort_findings, split_findings
from sparkeda.operators import anomaly as an
from sparkeda.operators import associations as assoc
from sparkeda.operators import catalog as cat
from sparkeda.operators import clustering as clu
from sparkeda.operators import compare as cmp
from sparkeda.operators import distributions as dist
from sparkeda.operators import images as img
from sparkeda.operators import quality as q
from sparkeda.operators import schema as sch
from sparkeda.operators import supervised as sup
from sparkeda.operators import timeseries as ts


class Run:
    """Gathers evidence, findings, warnings and failures of one analysis."""

    def __init__(self, goal: str, catalog: list[dict], callbacks, context):
        self.result = AnalysisResult(goal=goal, catalog=catalog, assumptions=list(context.assumptions), metadata={"goal": goal})
        self.callbacks = callbacks
        emit(callbacks, "analysis_started", goal=goal)

    def evidence(self, kind: str, value: Any, table: str | None = None, columns: tuple[str, ...] = (), method: str = "exact", confidence: float = 1.0) -> str:
        e = Evidence(kind, value, table, tuple(columns), method, confidence=confidence)
        self.result.evidence.append(e)
        emit(self.callbacks, "evidence_created", evidence=kind, id=e.id)
        return e.id

    def finding(self, title: str, severity: str, *ids: str, category: str = "quality_issue", confidence: float = 0.9, step: str | None = None, risk: str = "medium", table: str | None = None, columns: tuple[str, ...] = ()) -> None:
        self.result.findings.append(Finding(title, severity, ids, confidence, category))
        if step:
            self.result.plan.append(Step(step, risk, table, tuple(columns), ids))

    def warn(self, code: str, message: str) -> None:
        self.result.warnings.append(Warning_(code, message))
        emit(self.callbacks, "warning", code=code)

    def stage(self, name: str, table: str, work: Callable[[], Any]) -> Any:
        emit(self.callbacks, "stage_started", stage=name, table=table)
        try:
            return work()
        except Exception as error:  # noqa: BLE001  recorded, and the other stages go on
            self.result.failures.append({"stage": name, "table": table, "error": f"{type(error).__name__}: {str(error)[:300]}"})
            return None

    def done(self, status: str | None = None, summary: str = "") -> AnalysisResult:
        r = self.result
        r.findings = sort_findings(r.findings)
        issues, notes = split_findings(r.findings)
        r.status = status or ("completed_with_warnings" if r.failures or r.warnings else "completed")
        r.summary = summary or f"{len(issues)} issue(s) and {len(notes)} observation(s) from {len(r.evidence)} facts"
        emit(self.callbacks, "analysis_completed", status=r.status)
        return r


def rows(df: DataFrame) -> list[dict]:
    """A small result as plain rows, in a stable order."""
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=repr)


def _columns(catalog: list[dict], table: str) -> list[dict]:
    return next(t["columns"] for t in catalog if t["table"] == table)


def profile(tables, catalog, context, config, callbacks, detail: str = "standard", now: str | None = None) -> AnalysisResult:
    """Catalogue, data-quality checks (never sampled), distributions and associations."""
    run = Run("profile", catalog, callbacks, context)
    now = now or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d")
    caps = {"standard": (60, 30), "full": (250, 80)}[detail]
    run.evidence("dataset_shape", [{k: t[k] for k in ("table", "n_rows", "n_columns")} for t in catalog])
    for t in catalog:
        name, df = t["table"], tables[t["table"]]
        ev = run.evidence("table_quality_summary", {k: v for k, v in t.items() if k != "columns"}, name)
        if t["n_rows"] and t["n_duplicates"]:
            run.finding(f"Duplicate rows in {name}", "high" if t["n_duplicates"] >= 0.1 * t["n_rows"] else "medium", ev, step="review_duplicate_rows", risk="high", table=name)
        for c in t["columns"]:
            ev = run.evidence("column_profile", c, name, (c["column"],))
            if c["missing_rate"] >= 0.2:
                run.finding(f"High missingness in {name}.{c['column']}", "high" if c["missing_rate"] >= 0.5 else "medium", ev, step="review_missing_values", table=name, columns=(c["column"],))
            if "constant" in c["warnings"]:
                run.finding(f"Constant column {name}.{c['column']}", "low", ev, step="review_constant_column", risk="low", table=name, columns=(c["column"],))
            if c["kind"] != "numeric" and c["n_distinct"] == t["n_rows"] > 1:
                run.finding(f"{name}.{c['column']} has all-unique values", "info", ev, category="observation")
        run.stage("quality", name, lambda df=df, t=t: _quality(run, df, t, now))
        run.stage("distributions", name, lambda df=df, t=t: _distributions(run, df, t, caps[0], detail == "full"))
        run.stage("associations", name, lambda df=df, t=t: _associations(run, df, t, caps[1]))
    few = sum(t["n_rows"] for t in catalog) == 0
    if few:
        run.warn("insufficient_rows", "there are no rows")
    return run.done("insufficient_evidence" if few and not config.allow_insufficient_evidence else None)


def _quality(run: Run, df: DataFrame, t: dict, now: str) -> None:
    name, n = t["table"], t["n_rows"]
    for column, issue in q.structural_issues(df.columns):
        ev = run.evidence(f"quality_{issue}", {"column": column}, name, (column,), "header_name_scan")
        run.finding(f"Column header {column!r} is {issue.replace('_', ' ')}", "medium", ev)
    if n == 0:
        return
    twins = rows(q.aliased_columns(df))
    if twins:
        ev = run.evidence("quality_aliased_columns", twins, name, method="exact_column_equality")
        run.finding(f"Columns of {name} are copies of each other", "medium", ev)
    skip = {x["second"] for x in twins}
    for c in t["columns"]:
        col = c["column"]
        if col in skip:
            continue
        if c["kind"] == "string":
            kinds, layouts = rows(q.cell_types(df, col)), rows(q.date_layouts(df, col))
            dated = sum(x["n"] for x in layouts)
            values = n - c["n_missing"]
            numeric = q.numeric_text(df, col).first()
            if values >= 5 and dated >= 0.9 * values:
                ev = run.evidence("quality_date_text_format", layouts, name, (col,), "date_layout_scan")
                mixed = len(layouts) > 1
                unclear = any(x["n_first_over_12"] and x["n_second_over_12"] for x in layouts)
                run.finding(f"{name}.{col} holds dates as text" + (" in several layouts" if mixed else ""), "high" if unclear else "medium", ev, step="parse_dates", table=name, columns=(col,))
            elif numeric["is_numeric_text"]:
                ev = run.evidence("quality_numeric_as_text", numeric.asDict(), name, (col,), "numeric_coercion_rate")
                run.finding(f"{name}.{col} holds numbers as text", "medium", ev, step="cast_to_numeric", table=name, columns=(col,))
            elif len([k for k in kinds if k["n"] >= 0.01 * n]) > 1:
                ev = run.evidence("quality_mixed_types", kinds, name, (col,), "cell_class_counts")
                run.finding(f"{name}.{col} mixes kinds of values", "medium", ev)
            groups = rows(q.case_variants(df, col)) if c["n_distinct"] <= 500 else []
            if groups:
                ev = run.evidence("quality_inconsistent_formatting", groups, name, (col,), "fold_and_strip")
                run.finding(f"{name}.{col} writes one label in several ways", "high" if sum(g["n_rows"] for g in groups) >= 0.05 * n or len(groups) >= 5 else "medium", ev, step="normalise_labels", table=name, columns=(col,))
            hidden = q.disguised_missing(df, col).first()
            if hidden["n_hidden"]:
                ev = run.evidence("quality_disguised_missing", hidden.asDict(), name, (col,), "placeholder_match")
                run.finding(f"{name}.{col} hides missing values", "high" if hidden["effective_rate"] >= 0.2 else "medium", ev, step="replace_placeholders", table=name, columns=(col,))
        elif c["kind"] == "numeric":
            found = rows(q.numeric_sentinels(df, col))
            if found:
                ev = run.evidence("quality_disguised_missing", found, name, (col,), "negative_sentinel_match")
                run.finding(f"{name}.{col} hides missing values as numbers", "medium", ev, step="replace_placeholders", table=name, columns=(col,))
        elif c["kind"] == "datetime":
            bad = q.invalid_dates(df, col, now).first().asDict()
            for key, title in (("n_sentinel", "placeholder dates"), ("n_implausible", "implausible dates"), ("n_future", "dates in the future")):
                if bad[key]:
                    ev = run.evidence(f"quality_{key[2:]}_date", {key: bad[key]}, name, (col,), "calendar_window")
                    run.finding(f"{name}.{col} has {title}", "medium", ev)
    for a, b in q.range_pairs(df.columns):
        if family(df.schema[a].dataType) == family(df.schema[b].dataType) != "string":
            got = q.reversed_ranges(df, a, b).first().asDict()
            if got["n_reversed"]:
                ev = run.evidence("quality_reversed_date_range", got, name, (a, b), "range_order")
                run.finding(f"{name}: {b} lies before {a}", "high", ev)


def _distributions(run: Run, df: DataFrame, t: dict, cap: int, fit_laws: bool = False) -> None:
    name = t["table"]
    use = [c for c in t["columns"] if c["n_rows"] - c["n_missing"] >= 8]
    if len(use) > cap:
        run.warn("chart_columns_capped", f"{len(use) - cap} columns of {name} have no distribution")
    for c in use[:cap]:
        col = c["column"]
        if c["kind"] == "numeric":
            run.evidence("profile_distribution", {"shape": dist.shape(df, col).first(), "box": dist.box(df, col).first(), "modality": dist.modality_gap(df, col).first(), "histogram": rows(dist.histogram(df, col, min(24, max(6, c["n_rows"] // 2))))}, name, (col,), "histogram_moments")
            fit = run.stage("family_fit", name, lambda col=col: rows(dist.family_fit(df, col))) if fit_laws and c["n_distinct"] >= 20 else None
            if fit:
                run.evidence("profile_distribution_family", fit, name, (col,), "kolmogorov_smirnov", 0.7)
        elif c["semantic_type"] in ("categorical", "boolean"):
            freq = rows(dist.category_frequency(df, col))
            ev = run.evidence("profile_category_frequency", freq, name, (col,), "value_counts")
            if freq and max(f["rate"] for f in freq) >= 0.9 and c["n_distinct"] > 1:
                run.finding(f"{name}.{col} is dominated by one label", "info", ev, category="observation")
        elif c["kind"] == "datetime":
            ev = run.evidence("profile_timeline", rows(dist.timeline(df, col)), name, (col,), "period_counts")
            cover = ev and run.evidence("profile_time_coverage", {"gaps": ts.irregularity(df, col).first()}, name, (col,), "sorted_gap_scan")
            run.finding(f"Time coverage of {name}.{col}", "info", cover, category="observation")


def _associations(run: Run, df: DataFrame, t: dict, cap: int) -> None:
    name = t["table"]
    live = [c for c in t["columns"] if c["n_distinct"] >= 2 and "identifier" not in c["roles"]]
    if len(live) > cap:
        run.warn("association_columns_capped", f"{len(live) - cap} columns of {name} have no associations")
    numeric = [c["column"] for c in live[:cap] if c["kind"] == "numeric"]
    labels = [c["column"] for c in live[:cap] if c["semantic_type"] in ("categorical", "boolean") and c["n_distinct"] <= 50]
    if len(numeric) + len(labels) > 1:
        found = rows(assoc.association_matrix(df, numeric, labels))
        ev = run.evidence("profile_association_matrix", found, name, tuple(numeric + labels), "spearman_cramersv_correlation_ratio")
        for m in sorted((m for m in found if (m["strength"] or 0) >= 0.8), key=lambda m: (-m["strength"], m["first"], m["second"]))[:8]:
            run.finding(f"{m['first']} and {m['second']} are strongly associated in {name}", "info", ev, category="observation")
        for m in sorted((m for m in found if m["method"] == "spearman" and m["strength"] is not None), key=lambda m: (-m["strength"], m["first"], m["second"]))[:6]:
            points = cat.seeded_sample(df.select(m["first"], m["second"]).dropna(), 500, [m["first"], m["second"]])
            run.evidence("profile_scatter", rows(points), name, (m["first"], m["second"]), "seeded_sample_of_pairs")
            run.result.sampling.append(SamplingRecord("scatter", t["n_rows"], min(500, t["n_rows"]), reason="points of a chart"))
    holes = [c["column"] for c in t["columns"] if c["n_missing"]]
    if holes:
        run.evidence("profile_missingness", rows(q.missing_rates(df)), name, tuple(holes))
        if 1 < len(holes) <= 60:
            run.evidence("profile_co_missingness", [r for r in rows(q.co_missing(df, holes)) if r["jaccard"] >= 0.3], name, tuple(holes), "pairwise_jaccard")


def discover_schema(tables, catalog, context, config, callbacks, max_key_columns: int | None = None, min_key_uniqueness: float = 0.98, min_key_completeness: float = 0.98, min_relationship_inclusion: float = 0.9, min_relationship_confidence: float = 0.72) -> AnalysisResult:
    """Key and relationship candidates, roles, importance and layers of the tables; exact, nothing is sampled."""
    run = Run("discover_schema", catalog, callbacks, context)
    width = max_key_columns or {"quick": 1, "standard": 2, "deep": 3}[config.mode]
    if not 1 <= width <= 3:
        raise ValueError("max_key_columns is 1, 2 or 3")
    keys = [k for name, df in tables.items() if df.columns for k in (run.stage("keys", name, lambda name=name, df=df: sch.key_candidates(df, name, width, min_key_uniqueness, min_key_completeness)) or [])]
    for k in keys:
        run.evidence("schema_key_candidate", k, k["table"], tuple(k["key"].split(",")), "level_wise_key_search", k["confidence"])
    if len(tables) < 2:
        run.warn("single_table_schema_discovery", "one table has no relationships")
        return run.done(None if config.allow_insufficient_evidence else "insufficient_evidence")
    links = sch.relationship_candidates(tables, keys, min_relationship_inclusion, min_relationship_confidence)
    for r in links:
        ev = run.evidence("schema_relationship_candidate", r, r["child"], tuple(r["child_key"].split(",")), "inclusion_type_name", r["confidence"])
        run.finding(f"Candidate {r['cardinality'].replace('_', '-')} relationship: {r['child']} -> {r['parent']}", "medium" if r["orphan_rows"] else "low", ev, confidence=r["confidence"])
        if r["orphan_rows"]:
            run.finding(f"Possible orphan rows in {r['child']}", "high" if r["row_coverage"] < 0.95 else "medium", ev)
    if links:
        edges = [(r["child"], r["parent"]) for r in links]
        names = sorted(tables)
        spark = next(iter(tables.values())).sparkSession
        roles = rows(sch.graph_roles(spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame([(n,) for n in names], "`table` string")))
        depth, importance = sch.layers(names, edges), sch.pagerank(names, edges)
        graph = {"roles": roles, "importance": importance, "layers": depth, "links": links, "drawing": sch.graph_chart(names, roles, importance, depth, links)}
        run.evidence("schema_graph", graph, method="degree_and_pagerank")
        run.result.artifacts.append(Artifact("schema_graph", "Tables and relationships", graph))
    return run.done(None if links else "no_meaningful_structure", sch.schema_verdict(len(tables), links, roles if links else []))


def _one_table(run: Run, tables, table: str | None, column: str | None, goal: str) -> str | None:
    """The table to analyse: named, the only one, or the only one with the column."""
    if table is not None:
        if table not in tables:
            run.warn(f"{goal}_table_not_found", f"no table {table}")
            return None
        if column and column not in tables[table].columns:
            run.warn(f"{goal}_target_not_found", f"{table} has no column {column}")
            return None
        return table
    fit = [n for n, df in tables.items() if column is None or column in df.columns]
    if len(fit) == 1:
        return fit[0]
    run.warn(f"{goal}_target_not_found" if not fit else f"{goal}_target_ambiguous", f"{len(fit)} tables fit")
    return None


def _keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """df with the number of each row, from 0 in the order read: equal rows keep keys of their own, and a reader can look them up."""
    return row_index(df, "_row"), "_row"


def _first(run: Run, items: list, most: int, what: str) -> list:
    """The first items, with a warning if there are more."""
    if len(items) > most:
        run.warn("items_capped", f"{most} of {len(items)} {what} are looked at")
    return items[:most]


def _why(parts: list[dict], n_methods: int) -> str:
    """One sentence on a row, from its contributors by falling |z|."""
    if not parts:
        return f"flagged by {n_methods} check(s)"
    top = parts[0]
    return f"{top['column']} is {top['x']:g}, {top['direction']} the typical {top['median']:g} by {abs(top['z']):.1f} robust deviations; flagged by {n_methods} check(s)"


def anomaly_detection(tables, catalog, context, config, callbacks, table: str | None = None, target: str | None = None, expected_contamination: float | None = None) -> AnalysisResult:
    """Threshold, conditional and model-based detectors, rare labels, and the rows they agree on."""
    if expected_contamination is not None and not 0 < expected_contamination < 0.5:
        raise ValueError("expected_contamination lies between 0 and .5")
    run = Run("anomaly_detection", catalog, callbacks, context)
    target = target or context.target
    names, verdict = [table] if table else list(tables), []
    for name in names:
        if name not in tables:
            run.warn("anomaly_table_not_found", f"no table {name}")
            continue
        df, key = _keyed(tables[name])
        info = _columns(catalog, name)
        numeric = [c["column"] for c in info if c["kind"] == "numeric" and "identifier" not in c["roles"] and c["n_rows"] - c["n_missing"] >= 8 and c["n_distinct"] > 1 and c["column"] != target]
        numeric = _first(run, numeric, 12, f"numeric columns of {name}")
        labels = [c["column"] for c in info if c["kind"] in ("string", "boolean") and c["n_distinct"] <= 100]
        shapes, reviewed = [], 0
        if numeric:
            found = run.stage("univariate", name, lambda df=df: rows(an.univariate_outliers(df, key, numeric).groupBy("column").agg(F.count("*").alias("n"), F.max(F.abs("z")).alias("max_z"), F.max_by("value", F.abs("z")).alias("example"))))
            n = info[0]["n_rows"]
            for f in found or []:
                ev = run.evidence("anomaly_univariate_outlier", f, name, (f["column"],), "iqr_or_modified_z")
                if f["max_z"] >= 8 or f["n"] >= 0.05 * n:
                    run.finding(f"Univariate tail candidates in {name}.{f['column']}", "high" if f["n"] >= 0.05 * n else "medium", ev, step="review_outlier_candidates", table=name, columns=(f["column"],))
            for c in numeric:
                m = run.stage("modality", name, lambda df=df, c=c: dist.modality_gap(df, c).first().asDict())
                if m:
                    ev = run.evidence("anomaly_distribution_shape", m, name, (c,), "largest_gap")
                    if m["is_multimodal"]:
                        shapes.append(c)
                        run.finding(f"{name}.{c} looks like two populations", "high", ev)
        if len(numeric) > 1:
            joint = _first(run, numeric, 8, f"numeric columns of {name} for joint checks")
            flagged = an.flags(df, key, joint).persist()
            agree = run.stage("agreement", name, lambda flagged=flagged: rows(an.agreement(flagged, key)))
            if agree:
                run.evidence("anomaly_detector_agreement", agree, name, method="pairwise_jaccard")
            review = run.stage("consensus", name, lambda flagged=flagged: rows(an.consensus(flagged, key)))
            if review:
                ev = run.evidence("anomaly_consensus_review", review, name, tuple(numeric), "cross_detector_consensus", 0.8)
                run.finding(f"{len(review)} row(s) to review in {name}", "high", ev, step="review_flagged_rows", table=name)
                reviewed = len(review)
                told = run.stage("explanations", name, lambda df=df, review=review: rows(an.contributors(df, key, joint, [r[key] for r in review])))
                if told:
                    out = []
                    for r in review:
                        parts = sorted((t for t in told if t[key] == r[key]), key=lambda t: -abs(t["z"]))
                        out.append({"row": r[key], "n_methods": r["n_methods"], "contributors": parts, "why": _why([t for t in parts if abs(t["z"]) >= 2.0], r["n_methods"])})
                    run.evidence("anomaly_row_explanations", out, name, tuple(joint), "robust_z_by_column", 0.8)
            flagged.unpersist()
            points = run.stage("scatter", name, lambda df=df: [{"x": r[joint[0]], "y": r[joint[1]]} for r in rows(cat.seeded_sample(df.select(key, joint[0], joint[1]).dropna(), 500, [key], config.random_seed))])
            if points:
                run.evidence("anomaly_scatter", points, name, tuple(joint[:2]), "seeded_sample_of_rows")
                run.result.sampling.append(SamplingRecord("scatter", info[0]["n_rows"], len(points), reason="points of a chart"))
            peers = run.stage("conditional_examples", name, lambda df=df: rows(an.conditional_examples(df, key, joint)))
            if peers:
                run.evidence("anomaly_conditional_examples", peers, name, tuple(joint), "peer_band", 0.75)
            n = info[0]["n_rows"]
            top = max(1, min(25, math.ceil(n * (expected_contamination or 0.02))))
            models = {}
            if n >= 20:
                models["isolation_forest"] = run.stage("isolation_forest", name, lambda df=df: rows(an.isolation_forest(df, key, numeric, seed=config.random_seed).orderBy(F.desc("score"), key).limit(top)))
            if n >= 30:
                models["local_density"] = run.stage("local_density", name, lambda df=df: rows(an.local_outlier_factor(df, key, joint, min(20, n - 1)).orderBy(F.desc("lof"), key).limit(top)))
            for kind, found in models.items():
                if found:
                    run.evidence(f"anomaly_{kind}", found, name, tuple(numeric if kind == "isolation_forest" else joint), kind, 0.7)
            both = [{r[key] for r in found} for found in models.values() if found]
            if len(both) == 2:
                shared, either = both[0] & both[1], both[0] | both[1]
                ev = run.evidence("anomaly_model_agreement", {"n_both": len(shared), "n_either": len(either), "jaccard": round(len(shared) / len(either), 6), "rows": sorted(shared)}, name, tuple(joint), "top_rows_of_two_models", 0.7)
                if len(shared) / len(either) < 0.2:
                    run.finding(f"Density and isolation point at different rows of {name}", "low", ev, category="observation")
        if labels:
            for r in run.stage("rare", name, lambda df=df: rows(an.rare_categories(df, labels))) or []:
                ev = run.evidence("anomaly_rare_category", r, name, (r["column"],), "low_frequency")
                run.finding(f"Rare category in {name}.{r['column']}", "low", ev, confidence=0.68)
        if len(labels) > 1:
            pairs = run.stage("rare_pairs", name, lambda df=df: rows(an.rare_pairs(df, _first(run, labels, 8, f"label columns of {name}")).orderBy("n", "first", "second", "a", "b").limit(200)))
            if pairs:
                ev = run.evidence("anomaly_rare_category_combination", pairs, name, tuple(labels[:8]), "low_frequency_pairs", 0.66)
                run.finding(f"Rare category combinations in {name}", "low", ev, confidence=0.66)
        if target and target in tables[name].columns:
            run.evidence("anomaly_label_summary", rows(sup.target_classes(df, target)), name, (target,))
        if shapes:
            verdict.append(f"{name}: {', '.join(shapes)} hold(s) two populations to part, rather than scattered outliers")
        elif reviewed:
            verdict.append(f"{name}: {reviewed} row(s) to review")
    return run.done(None if run.result.evidence else "insufficient_evidence", "; ".join(verdict))


def _admitted(df: DataFrame, target: str, leaks: set[str], cap: int) -> tuple[list[str], list[str]]:
    use = cat.feature_admission(df, target, cap).collect()
    return [r["column"] for r in use if r["use"] == "numeric" and r["column"] not in leaks][:30], [r["column"] for r in use if r["use"] == "categorical" and r["column"] not in leaks][:30]


def classification(tables, catalog, context, config, callbacks, target: str | None = None, table: str | None = None, max_categories: int = 50) -> AnalysisResult:
    """Target, leakage, associations, conflicts, split guidance and a probe that never sees a leaking column."""
    run = Run("classification", catalog, callbacks, context)
    target = target or context.target
    if not target:
        run.warn("classification_target_required", "name a target")
        return run.done("insufficient_evidence")
    name = _one_table(run, tables, table, target, "classification")
    if name is None:
        return run.done("insufficient_evidence")
    df, key = _keyed(tables[name])
    classes = rows(sup.target_classes(df, target))
    ev = run.evidence("classification_target_summary", classes, name, (target,))
    real = [c for c in classes if c["label"] != "<NA>"]
    if len(real) < 2:
        run.finding(f"Target validity risk in {name}", "high", ev)
        return run.done("insufficient_evidence")
    major = max(c["share"] for c in classes)
    if major >= 0.8 or min(c["n"] for c in real) < 10:
        run.finding(f"Class imbalance in {name}", "high" if major >= 0.9 else "medium", ev, step="review_class_imbalance_strategy", risk="high", table=name)
    info = {c["column"]: c for c in _columns(catalog, name)}
    others = [c for c in info if c != target]
    leaks: set[str] = set()
    for c in others:
        if "identifier" in info[c]["roles"]:
            ev = run.evidence("classification_identifier_feature", info[c], name, (c,), "identifier_role")
            run.finding(f"Identifier-like feature: {c}", "high", ev, step="exclude_identifier_feature", risk="high", table=name, columns=(c,))
    checked = [c for c in others if "identifier" not in info[c]["roles"] and info[c]["n_distinct"] > 1 and info[c]["kind"] != "datetime"]
    for r in (run.stage("leakage", name, lambda: rows(sup.leakage(df, target, checked))) or []) if checked else []:
        if r["suspect"] or r["named"]:
            ev = run.evidence("classification_leakage_candidate", r, name, (r["feature"],), "value_rule_screen", 0.92 if r["suspect"] else 0.64)
            run.finding(f"Potential target leakage: {r['feature']}", "critical" if r["exact_copy"] or r["accuracy"] >= 0.999 else "high", ev, step="review_target_leakage_candidate", risk="high", table=name, columns=(r["feature"],))
            if r["suspect"]:
                leaks.add(r["feature"])
    numeric, labels = _admitted(tables[name], target, leaks, max_categories)
    for c in numeric:
        r = run.stage("eta", name, lambda c=c: assoc.eta_squared(df, c, target).first().asDict())
        if r:
            ev = run.evidence("classification_numeric_association", r, name, (c, target), "one_way_effect_size", 0.78)
            if (r["eta2"] or 0) >= 0.35:
                run.finding(f"Strong target association: {c}", "medium", ev)
    for c in labels:
        r = run.stage("cramers_v", name, lambda c=c: assoc.cramers_v(df, c, target, corrected=False).first().asDict())
        if r:
            ev = run.evidence("classification_categorical_association", r, name, (c, target), "cramers_v", 0.76)
            if (r["strength"] or 0) >= 0.35:
                run.finding(f"Strong target association: {c}", "medium", ev)
    if checked:
        for r in run.stage("missing", name, lambda: rows(sup.missing_by_class(df, target, checked))) or []:
            if r["differs"]:
                ev = run.evidence("classification_missingness_by_class", r, name, (r["column"],), "class_conditional_missingness", 0.84)
                run.finding(f"Class-dependent missingness: {r['column']}", "medium", ev)
        clash = run.stage("conflicts", name, lambda: sup.conflicting_labels(df, target, [c for c in others if "identifier" not in info[c]["roles"]]).first().asDict())
        if clash and clash["n_groups"]:
            ev = run.evidence("classification_conflicting_duplicates", clash, name, method="feature_group_labels", confidence=0.86)
            run.finding(f"Conflicting duplicate labels in {name}", "high", ev)
    _splits(run, df, name, target, context, key, "classification")
    if len(numeric) and sum(c["n"] for c in real) >= 30 and min(c["n"] for c in real) >= 3:
        folds = 3 if config.mode == "quick" else 5
        p = run.stage("probe", name, lambda: sup.logistic_probe(df, target, numeric, key, folds, config.random_seed).first().asDict())
        if p:
            ev = run.evidence("classification_probe_model", p, name, tuple(numeric), "leakage_screened_logistic_probe", 0.74)
            if p["balanced_accuracy"] < 0.6 or p["lift"] < 0.05:
                run.finding(f"Weak classification separability in {name}", "medium", ev)
            elif p["balanced_accuracy"] >= 0.85 and p["lift"] >= 0.2:
                run.finding(f"Strong classification separability in {name}", "low", ev)
    points = [c for c in numeric if not info[c]["n_missing"]]
    if points and sum(c["n"] for c in real) >= 30:
        scaled = clu.matrix(df.where(F.col(target).isNotNull()), key, points)
        near = run.stage("neighbours", name, lambda: rows(sup.neighbour_disagreement(scaled.select(key, F.array(*points).alias("v")).join(df.select(key, target), key), key, "v", target).agg(F.count("*").alias("n"), F.round(F.avg("disagreement"), 6).alias("mean"), F.count_if(F.col("disagreement") >= 0.8).alias("n_against")))[0])
        if near:
            ev = run.evidence("classification_neighborhood_disagreement", near, name, tuple(points), "nearest_neighbours", 0.7)
            if near["n_against"] >= 0.05 * near["n"]:
                run.finding(f"{near['n_against']:,} row(s) of {name} sit among rows of other classes", "medium", ev, step="review_suspicious_labels", table=name)
    run.result.artifacts.append(Artifact("metric_table", "Class balance", classes))
    return run.done()


def _splits(run: Run, df: DataFrame, name: str, target: str, context, key: str, goal: str) -> None:
    for column in filter(None, [context.entity_id, *context.groups]):
        if column in df.columns:
            got = run.stage("groups", name, lambda column=column: sup.repeated_entities(df, column).first().asDict())
            if got:
                ev = run.evidence(f"{goal}_split_guidance", got | {"column": column}, name, (column,), "repeated_entities", 0.82)
                if got["n_repeated"]:
                    run.finding(f"Repeated entities in {column}", "high", ev)
    if context.timestamp and context.timestamp in df.columns:
        got = run.stage("time", name, lambda: rows(sup.label_shift(df, target, context.timestamp, key).limit(50)))
        if got:
            ev = run.evidence(f"{goal}_split_guidance", got, name, (context.timestamp,), "early_late_quarter", 0.82)
            run.finding(f"Time-ordered validation needed for {target}", "medium", ev)


def regression(tables, catalog, context, config, callbacks, target: str | None = None, table: str | None = None, max_categories: int = 50) -> AnalysisResult:
    """Target shape, leakage, signal, and two probes with their residuals; leaks are excluded before a probe trains."""
    run = Run("regression", catalog, callbacks, context)
    target = target or context.target
    if not target:
        run.warn("regression_target_required", "name a target")
        return run.done("insufficient_evidence")
    name = _one_table(run, tables, table, target, "regression")
    if name is None:
        return run.done("insufficient_evidence")
    if family(tables[name].schema[target].dataType) != "numeric":
        run.warn("regression_target_not_numeric", f"{target} is no number")
        return run.done("insufficient_evidence")
    df, key = _keyed(tables[name])
    info = {c["column"]: c for c in _columns(catalog, name)}
    if info[target]["n_rows"] - info[target]["n_missing"] < 30 or info[target]["n_distinct"] < 2:
        run.evidence("regression_target_summary", info[target], name, (target,))
        return run.done("insufficient_evidence")
    facts = sup.target_quantiles(df, target).first().asDict()
    ev = run.evidence("regression_target_summary", facts, name, (target,))
    if info[target]["n_missing"]:
        run.finding(f"Missing target values in {name}", "high" if info[target]["missing_rate"] >= 0.2 else "medium", ev)
    if facts["discrete"]:
        run.finding(f"Target takes few distinct values: {target}", "low", ev, category="observation")
    moves = run.stage("transforms", name, lambda: rows(sup.target_transforms(df, target, with_power=True)))
    if moves:
        ev = run.evidence("regression_target_shape", moves, name, (target,), "skew_after_transform")
        if any(m["recommended"] for m in moves):
            run.finding("Target is skewed and a transform evens it out", "low", ev, category="observation", step="consider_target_transformation", table=name, columns=(target,))
    spikes = [] if facts["discrete"] else run.stage("spikes", name, lambda: rows(sup.target_spikes(df, target))) or []
    if spikes:
        ev = run.evidence("regression_target_spike", spikes, name, (target,), "repeated_value_share")
        run.finding(f"Values of {target} pile up at the {spikes[0]['position']}", "high" if max(s["share"] for s in spikes) >= 0.05 else "medium", ev, step="review_target_censoring", risk="high", table=name)
    heap = run.stage("heaping", name, lambda: sup.target_heaping(df, target).first().asDict())
    if heap and heap["base"]:
        run.finding(f"Round-number heaping in {target}", "low", run.evidence("regression_target_heaping", heap, name, (target,), "multiple_share"), category="observation")
    leaks: set[str] = set()
    strength: dict[str, float] = {}
    for c in [c for c in info if c != target]:
        if "identifier" in info[c]["roles"]:
            ev = run.evidence("regression_identifier", info[c], name, (c,), "identifier_role")
            run.finding(f"Identifier-like feature: {c}", "high", ev, step="exclude_identifier_feature", risk="high", table=name, columns=(c,))
            continue
        if info[c]["n_distinct"] < 2 or info[c]["kind"] == "datetime" or (info[c]["kind"] != "numeric" and info[c]["n_distinct"] > max_categories):
            continue
        if info[c]["kind"] == "numeric":
            r = run.stage("association", name, lambda c=c: assoc.pearson(df, [c, target]).first().asDict() | {"rho": assoc.spearman(df, [c, target]).first()["rho"], "binned": assoc.binned_eta_squared(df, c, target).first()["eta2"]})
            explained = (r["r"] or 0) ** 2 if r else 0.0
        else:
            r = run.stage("association", name, lambda c=c: assoc.eta_squared(df, target, c, 20).first().asDict())
            explained = (r["eta2"] or 0) if r else 0.0
        if r is None:
            continue
        strength[c] = max(explained, (r.get("binned") or 0))
        ev = run.evidence("regression_association", r, name, (c, target), "correlation_or_eta_squared", 0.78)
        if explained >= 0.98 or sup.shares_target_name(target, c):
            run.finding(f"Potential target leakage: {c}", "critical" if explained >= 0.999 else "high", ev, step="review_target_leakage_candidate", risk="high", table=name, columns=(c,))
            if explained >= 0.98:
                leaks.add(c)
        elif (r.get("binned") or 0) - explained >= 0.10 and (r.get("binned") or 0) >= 0.05:
            run.finding(f"{c} relates to the target non-linearly", "low", ev, category="observation")
    numeric, groups = _admitted(tables[name], target, leaks, max_categories)
    if len(numeric) > 1:
        twins = run.stage("redundancy", name, lambda: {"pairs": rows(sup.redundant_pairs(df, numeric)), "vif": rows(sup.vif(df, numeric))})
        if twins:
            ev = run.evidence("regression_redundancy", twins, name, tuple(numeric), "correlation_and_vif", 0.8)
            if twins["pairs"]:
                run.finding("Redundant features carry the same information", "medium", ev, category="observation", step="review_redundant_features", risk="low", table=name)
    _splits(run, df, name, target, context, key, "regression")
    if numeric:
        folds = 3 if config.mode == "quick" else 5
        scored = run.stage("probe", name, lambda: sup.ridge_probe(df, target, numeric, key, folds).persist())
        if scored is not None:
            probe = run.stage("metrics", name, lambda: {"ridge": sup.regression_metrics(scored).first(), "huber": sup.regression_metrics(sup.huber_probe(df, target, numeric, key, folds)).first()})
            if probe:
                ev = run.evidence("regression_probe", probe, name, tuple(numeric), "leakage_screened_dual_probe", 0.74)
                if probe["ridge"]["r2"] < 0.05:
                    run.finding(f"Features carry little signal for {target}", "high", ev)
                if probe["ridge"]["mae"] - probe["huber"]["mae"] >= 0.1 * probe["ridge"]["mae"] > 0:
                    run.finding("A few rows distort the conventional fit", "medium", ev)
            shape = run.stage("residuals", name, lambda: {"shape": sup.residual_shape(scored, "y", "p").first(), "bins": rows(sup.residual_bins(scored, "y", "p"))})
            if shape:
                ev = run.evidence("regression_residual_shape", shape, name, method="binned_residuals", confidence=0.76)
                spread = [b["std"] for b in shape["bins"] if b["std"]]
                if spread and max(spread) >= 2 * min(spread):
                    run.finding("Error spread changes across the prediction range", "medium", ev)
            points = run.stage("scatter", name, lambda: [{"x": r["p"], "y": r["y"] - r["p"]} for r in rows(cat.seeded_sample(scored.select(key, "y", "p"), 500, [key], config.random_seed))])
            if points:
                run.evidence("regression_residual_scatter", points, name, (target,), "seeded_sample_of_rows")
                run.result.sampling.append(SamplingRecord("residual_scatter", info[target]["n_rows"], len(points), reason="points of a chart"))
            for c in _first(run, groups, 8, f"label columns of {name}"):
                bad = run.stage("error_concentration", name, lambda c=c: rows(sup.subgroup_error(scored.join(df.select(key, F.col(c).cast("string").alias("_g")), key), "y", "p", "_g").where("ratio >= 1.5")))
                if bad:
                    run.finding(f"Errors gather in some values of {c}", "medium", run.evidence("regression_error_concentration", bad, name, (c,), "subgroup_mean_error", 0.76))
            scored.unpersist()
        thin = [{"column": c, "bins": found} for c in _first(run, numeric, 8, f"numeric columns of {name}") if (found := run.stage("support", name, lambda c=c: rows(sup.weak_support(df, c).where("thin"))))]
        if thin:
            run.evidence("regression_weak_support", thin, name, tuple(t["column"] for t in thin), "rows_by_equal_width", 0.8)
        top = run.stage("influence", name, lambda: rows(sup.cooks_distance(df, target, numeric, key).where((F.col("cook") >= 0.5) | (F.abs("error") >= 4)).orderBy(F.desc("cook")).limit(20)))
        if top:
            ev = run.evidence("regression_influence", top, name, tuple(numeric), "leverage_and_cook", 0.8)
            run.finding(f"{len(top)} row(s) worth reviewing", "medium", ev, step="review_influential_rows", table=name)
            odd = run.stage("extreme_features", name, lambda: rows(an.contributors(df, key, numeric, [t[key] for t in top], 2.5)))
            if odd:
                run.evidence("regression_extreme_features", odd, name, tuple(numeric), "robust_z_by_column", 0.75)
    return run.done()


def time_series(tables, catalog, context, config, callbacks, value: str | None = None, timestamp: str | None = None, entity_id: str | None = None, horizon: int | None = None, table: str | None = None, now: str | None = None) -> AnalysisResult:
    """Index, gaps, cycles, stationarity, shifts, one-off values, intermittency, leads and a backtest plan."""
    run = Run("time_series", catalog, callbacks, context)
    value, entity_id = value or context.target, entity_id or context.entity_id
    if not value:
        run.warn("time_series_value_required", "name a value column")
        return run.done("insufficient_evidence")
    name = _one_table(run, tables, table, value, "time_series")
    if name is None:
        return run.done("insufficient_evidence")
    df = tables[name]
    if family(df.schema[value].dataType) != "numeric":
        run.warn("time_series_value_not_numeric", f"{value} is no number")
        return run.done("insufficient_evidence")
    timestamp = timestamp or context.timestamp
    dates = columns_of(df, "datetime")
    if timestamp is None:
        if len(dates) != 1:
            run.warn("time_series_timestamp_ambiguous" if dates else "time_series_timestamp_not_found", f"{len(dates)} columns hold times")
            return run.done("insufficient_evidence")
        timestamp = dates[0]
    if timestamp not in df.columns:
        run.warn("time_series_timestamp_not_found", f"{name} has no {timestamp}")
        return run.done("insufficient_evidence")
    now = now or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d")
    index = ts.index_facts(df, timestamp, now).first().asDict()
    freq = ts.infer_frequency(df, timestamp).first().asDict()
    ev = run.evidence("time_series_index", index | freq, name, (timestamp,))
    if index["n_future"]:
        run.finding("Timestamps in the future", "medium", ev)
    if index["n_distinct"] < 20:
        return run.done("insufficient_evidence")
    twice = run.stage("duplicates", name, lambda: ts.duplicate_timestamps(df, timestamp, value, entity_id).first().asDict())
    if twice and twice["n_groups"]:
        run.finding("Duplicate timestamps in the series", "high", run.evidence("time_series_duplicates", twice, name, (timestamp,)), step="resolve_duplicate_timestamps", risk="high", table=name)
    unit = {"second": "second", "minute": "minute", "15min": "minute", "30min": "minute", "hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}.get(freq["frequency"], "day")
    step = {"quarter": "INTERVAL 3 MONTH"}.get(unit, f"INTERVAL 1 {unit.upper()}")
    if entity_id:
        shape = run.stage("panel", name, lambda: rows(ts.composition(df, timestamp, entity_id, unit)))
        if shape and len(shape) > 1:
            run.finding("The aggregate is not made of the same series throughout", "high", run.evidence("time_series_composition", shape[:200], name, (entity_id,)))
        run.warn("time_series_panel_aggregated", "entities are summed")
        spans = run.stage("panel_spans", name, lambda: rows(ts.panel(df, timestamp, entity_id, unit)))
        if spans:
            longest = max(p["n_periods"] for p in spans)
            short = [p for p in spans if p["n_periods"] < 0.5 * longest]
            ev = run.evidence("time_series_panel", {"n_entities": len(spans), "n_short": len(short), "entities": sorted(spans, key=lambda p: (p["n_periods"], repr(p)))[:50]}, name, (entity_id,))
            if len(spans) > 1 and len(short) >= 0.1 * len(spans):
                run.finding(f"{len(short)} of {len(spans)} series of {entity_id} are much shorter than the longest", "medium", ev)
    series = ts.per_period(df, timestamp, value, unit, "sum" if entity_id else "avg")
    grid = ts.regular_grid(series, step).persist()
    for kind, title in (("gap", "period(s) were never recorded"), ("blank", "period(s) recorded with no value")):
        found = run.stage(kind, name, lambda kind=kind: rows(ts.blocks(grid, kind)))
        if found:
            n = sum(f["n_periods"] for f in found)
            longest = max(f["n_periods"] for f in found)
            ev = run.evidence(f"time_series_{kind}s", sorted(found, key=lambda f: -f["n_periods"])[:12], name, (timestamp, value))
            run.finding(f"{n:,} {title}", "high" if longest >= 3 else "medium", ev, step="review_unrecorded_periods", risk="high", table=name)
    odd = run.stage("spacing", name, lambda: ts.irregularity(df, timestamp).first().asDict())
    if odd and odd["irregular"]:
        run.finding("Observations are not evenly spaced", "medium", run.evidence("time_series_irregularity", odd, name, (timestamp,)))
    full = ts.interpolate(grid).persist()
    n, filled = full.agg(F.count("*"), F.count_if("filled")).first()
    if filled:
        run.warn("time_series_interpolated_for_analysis", f"{filled} of {n} periods are interpolated")
    period = max(2, freq["period"]) if freq["frequency"] != "custom" else 7
    hist = ts.history(n, period, horizon or max(1, n // 10))
    ev = run.evidence("time_series_history", hist, name)
    if horizon and not (hist["enough_history"] and hist["horizon_ok"]):
        run.finding("Not enough history for the requested forecast", "high", ev)
    plan = run.stage("backtest", name, lambda: rows(ts.backtest_plan(full, period, horizon)))
    run.evidence("time_series_validation_plan", plan or [], name)
    if not plan:
        run.finding("Too short to backtest", "high", run.result.evidence[-1].id)
    if n >= 2 * period:
        s = run.stage("stl", name, lambda: ts.stl_strength(full, period).first().asDict())
        if s:
            ev = run.evidence("time_series_decomposition", s, name, (value,), "stl", 0.8)
            if (s["cycle_strength"] or 0) >= 0.3:
                run.finding("Clear seasonality" if s["cycle_strength"] >= 0.6 else "Some seasonality", "low", ev, category="observation")
        odd = run.stage("outliers", name, lambda: rows(ts.remainder_outliers(ts.moving_average_parts(full, period))))
        if odd:
            run.finding(f"{len(odd)} one-off value(s) in the series", "low", run.evidence("time_series_outliers", odd, name, (value,), "remainder_fences"), category="observation")
    r = run.stage("acf", name, lambda: rows(ts.acf(full, max(1, min(40, n // 3)))))
    if r:
        run.evidence("time_series_autocorrelation", {"acf": r, "seasonal": [x for x in r if x["lag"] % period == 0], "pacf": run.stage("pacf", name, lambda: rows(ts.pacf(full, max(1, min(40, n // 3)))))}, name, (value,), "acf")
    st = run.stage("stationarity", name, lambda: ts.stationarity(full).first().asDict())
    if st:
        run.finding(f"The series is {st['verdict'].replace('_', ' ')}", "low", run.evidence("time_series_stationarity", st, name, (value,), "adf_kpss", 0.8), category="observation")
    shifts = run.stage("shifts", name, lambda: rows(ts.change_points(full, period)))
    if shifts:
        run.finding(f"{len(shifts)} level shift(s) in the series", "medium", run.evidence("time_series_change_points", shifts, name, (value,), "cusum_binary_segmentation"), category="observation")
    zero = run.stage("intermittency", name, lambda: ts.intermittency(full).first().asDict())
    if zero and zero["zero_rate"] >= 0.05:
        run.finding(f"Demand pattern is {zero['kind']}", "medium" if zero["kind"] == "lumpy" else "low", run.evidence("time_series_intermittency", zero, name, (value,)), category="observation")
    grid.unpersist()
    full.unpersist()
    return run.done()


def clustering(tables, catalog, context, config, callbacks, features: list[str] | None = None, table: str | None = None) -> AnalysisResult:
    """Readiness, tendency, sweep; segments only where the data is clustered and a k is stable."""
    run = Run("clustering", catalog, callbacks, context)
    name = _one_table(run, tables, table, None, "clustering")
    if name is None:
        return run.done("insufficient_evidence")
    info = _columns(catalog, name)
    missing = [c for c in features or [] if c not in tables[name].columns]
    if missing:
        run.warn("clustering_feature_not_found", ", ".join(missing))
        return run.done("insufficient_evidence")
    df, key = _keyed(tables[name])
    use = [c["column"] for c in info if c["kind"] == "numeric" and c["n_distinct"] > 1 and "identifier" not in c["roles"] and (not features or c["column"] in features)][:30]
    n = info[0]["n_rows"] if info else 0
    if not use or n < 30:
        run.warn("clustering_no_usable_features", f"{len(use)} features, {n} rows")
        return run.done("insufficient_evidence")
    ranges = rows(clu.feature_ranges(df, use))
    ev = run.evidence("clustering_features", ranges, name, tuple(use))
    if ranges[0]["scale_ratio"] and ranges[0]["scale_ratio"] >= 100:
        run.finding("Features differ enormously in scale", "low", ev, category="observation")
    if max(r["missing_rate"] for r in ranges) >= 0.05:
        run.finding("Missing values in the distance features", "medium", ev)
    if len(use) > 1:
        twins = rows(sup.redundant_pairs(df, use))
        if twins:
            run.finding("The same quantity is present twice", "medium", run.evidence("clustering_redundancy", twins, name, tuple(use), "pearson", 0.88), category="observation", step="review_redundant_clustering_features", risk="low", table=name)
        run.stage("geometry", name, lambda: run.evidence("clustering_geometry", clu.geometry(df, key, use, config.random_seed).first(), name, tuple(use), "pca_and_contrast", 0.84))
    twice = run.stage("duplicates", name, lambda: clu.near_duplicates(df, key, use, seed=config.random_seed).first().asDict())
    if twice:
        ev = run.evidence("clustering_duplicates", twice, name, method="exact_and_nearest")
        if twice["n_repeated"] >= 0.05 * n:
            run.finding(f"{twice['n_repeated']:,} duplicate rows", "medium", ev)
    h = clu.hopkins(df, key, use, seed=config.random_seed).first().asDict()
    ev = run.evidence("clustering_tendency", h, name, tuple(use), "repeated_hopkins", 0.8)
    run.finding("The data shows no cluster tendency" if h["tendency"] == "none" else "The data is more clustered than chance" if h["tendency"] == "clustered" else "Weak cluster tendency", "high" if h["tendency"] == "none" else "low", ev, category="quality_issue" if h["tendency"] == "none" else "observation")
    ks = clu.candidate_k(n)[: {"quick": 4, "standard": 6, "deep": 9}[config.mode]]
    sweep = rows(clu.kmeans_sweep(df, key, use, ks, {"quick": 1, "standard": 2, "deep": 4}[config.mode], config.random_seed))
    ev = run.evidence("clustering_k_sweep", sweep, name, tuple(use), "kmeans_sweep_with_stability", 0.78)
    good = [s for s in sweep if s["candidate"]]
    if not good or h["tendency"] == "none":
        run.finding("No cluster count produced a stable partition", "high", ev)
        return run.done("no_meaningful_structure")
    k = max(good, key=lambda s: (s["silhouette"], -s["k"]))["k"]
    run.finding(f"{k} groups reproduce on resampled rows", "low", ev, category="observation")
    labelled, _ = clu.kmeans_labels(clu.matrix(df, key, use), key, use, k, config.random_seed)
    run.evidence("clustering_segments", rows(clu.segment_profile(labelled, "label", use)), name, tuple(use), "segment_profile", 0.72)
    for c in _first(run, [c["column"] for c in info if c["kind"] in ("string", "boolean") and 2 <= c["n_distinct"] <= 50], 8, f"label columns of {name}"):
        lift = run.stage("category_lift", name, lambda c=c: rows(clu.category_lift(labelled.select(key, "label").join(df.select(key, c), key), "label", c)))
        if lift:
            run.evidence("clustering_category_profile", lift, name, (c,), "lift_by_segment", 0.7)
    apart = run.stage("silhouette", name, lambda: rows(clu.silhouette(labelled, key, use)))
    if apart:
        run.evidence("clustering_silhouette_by_segment", apart, name, tuple(use), "silhouette", 0.76)
    moved = run.stage("sensitivity", name, lambda: rows(clu.sensitivity(df, key, use, k, config.random_seed))) if len(use) > 1 else None
    if moved:
        run.evidence("clustering_sensitivity", moved, name, tuple(use), "leave_one_feature_out", 0.7)
    flat = run.stage("projection", name, lambda: rows(clu.pca_projection(df, key, use, seed=config.random_seed))) if len(use) > 1 else None
    if flat:
        run.evidence("clustering_projection", flat, name, tuple(use), "pca", 0.7)
        run.result.sampling.append(SamplingRecord("projection", n, min(n, 1200), reason="points of a chart"))
    sizes = [s["n"] for s in rows(labelled.groupBy("label").agg(F.count("*").alias("n")))]
    uneven = max(sizes) > 5 * min(sizes)
    advice = "gaussian_mixture" if uneven and h["tendency"] == "clustered" else "kmeans" if h["tendency"] == "clustered" else "density_based"
    run.evidence("clustering_algorithm_advice", {"advice": advice, "largest": max(sizes), "smallest": min(sizes), "tendency": h["tendency"]}, name, tuple(use), "shape_of_segments", 0.6)
    return run.done()


def compare(base, base_catalog, other, other_catalog, context, callbacks) -> AnalysisResult:
    """Tables of one name side by side; a single table on either side is compared whatever its name."""
    run = Run("compare_datasets", base_catalog + other_catalog, callbacks, context)
    pairs = [(n, n) for n in base if n in other]
    if not pairs and len(base) == len(other) == 1:
        pairs = [(next(iter(base)), next(iter(other)))]
        run.warn("table_name_mismatch", f"{pairs[0][0]} is compared with {pairs[0][1]}")
    if not pairs:
        run.warn("no_common_tables", "the datasets have no table in common")
        return run.done("completed_with_warnings")
    for a, b in pairs:
        numeric, labels = cmp.common_columns(base[a], other[b])
        for c in numeric:
            run.stage("numeric", a, lambda a=a, b=b, c=c: run.evidence("column_comparison_chart", {"bins": rows(cmp.numeric_histograms(base[a], other[b], c)), "base": cmp.numeric_summary(base[a], c, "base").first(), "compare": cmp.numeric_summary(other[b], c, "compare").first()}, a, (c,), "joint_histogram"))
        for c in labels:
            run.stage("labels", a, lambda a=a, b=b, c=c: run.evidence("column_comparison_chart", {"bars": rows(cmp.category_counts(base[a], other[b], c)), "base": cmp.category_summary(base[a], c, "base").first(), "compare": cmp.category_summary(other[b], c, "compare").first()}, a, (c,), "joint_bar_chart"))
    return run.done()


def images(files: DataFrame, context, callbacks, threshold: int = 4) -> AnalysisResult:
    """Audit of an image folder: unreadable files, duplicates and leaks, quality, traps, label profiles."""
    run = Run("profile_images", [], callbacks, context)
    rec = img.records(files).persist()
    n, bad = rec.agg(F.count("*"), F.count_if(~F.col("valid"))).first()
    if not n:
        run.warn("no_image_files", "the folder has no images")
        return run.done("insufficient_evidence")
    ev = run.evidence("image_dataset_summary", {"n": n, "n_invalid": bad, "formats": rows(rec.groupBy("format").count()), "sizes": rows(rec.groupBy("width", "height").count())}, "images")
    if bad:
        run.finding("Unreadable image files", "critical" if bad >= 0.05 * n else "high", ev, step="review_unreadable_images", risk="high")
    same = rows(img.exact_duplicates(rec).limit(200))
    near = rows(img.near_duplicate_pairs(rec, threshold).orderBy("distance", "first", "second").limit(50))
    if same or near:
        ev = run.evidence("image_duplicate_summary", {"exact": same, "near": near}, "images", method="sha256_and_perceptual_hash", confidence=0.86)
        run.finding("Duplicate or near-duplicate image candidates", "high" if sum(s["n"] for s in same) >= max(2, 0.05 * n) else "medium", ev, step="review_duplicate_images", risk="high")
        if any(s["n_splits"] > 1 for s in same):
            run.finding("Duplicate images span train and evaluation splits", "critical", ev, step="remove_cross_split_duplicate_images", risk="high")
        if any(s["n_labels"] > 1 for s in same):
            run.finding("Identical images carry conflicting labels", "high", ev)
    flags, traps = rows(img.quality_flags(rec).limit(200)), rows(img.loader_traps(rec).limit(200))
    if flags:
        run.finding("Basic image quality flags", "medium", run.evidence("image_quality_summary", flags, "images", method="grey_metrics", confidence=0.82))
    if traps:
        ev = run.evidence("image_loader_traps", traps, "images", method="header_scan", confidence=0.95)
        kinds = {t["trap"] for t in traps}
        if "truncated" in kinds:
            run.finding("Truncated image files", "high", ev)
        if "orientation" in kinds:
            run.finding("Images will rotate depending on the loader", "medium", ev, step="normalize_exif_orientation")
        if "extension" in kinds:
            run.finding("File extensions do not match the actual encoding", "medium", ev)
        if kinds & {"grey_as_colour", "alpha"}:
            run.finding("Channel layout is inconsistent", "low", ev)
    profiles = rows(img.label_profiles(rec))
    run.evidence("image_label_profile", profiles, "images")
    apart = img.deviating_labels(profiles)
    if apart:
        run.finding("Some labels look unlike the others", "low", run.evidence("image_deviating_labels", apart, "images", method="robust_z_of_label_means", confidence=0.7), category="observation")
    odd = run.stage("outliers", "images", lambda: rows(img.outliers(rec).limit(200)))
    if odd:
        run.evidence("image_outliers", odd, "images", method="robust_z_of_metrics", confidence=0.7)
    run.evidence("image_manifest", rows(img.manifest(rec)), "images", method="counts_by_split_label_format")
    rec.unpersist()
    return run.done()


RECIPES = {
    "profile": (profile, {"detail", "now"}),
    "discover_schema": (discover_schema, {"max_key_columns", "min_key_uniqueness", "min_key_completeness", "min_relationship_inclusion", "min_relationship_confidence"}),
    "anomaly_detection": (anomaly_detection, {"table", "target", "expected_contamination"}),
    "classification": (classification, {"target", "table", "max_categories"}),
    "regression": (regression, {"target", "table", "max_categories"}),
    "time_series": (time_series, {"value", "timestamp", "entity_id", "horizon", "table", "now"}),
    "clustering": (clustering, {"features", "table"}),
}
