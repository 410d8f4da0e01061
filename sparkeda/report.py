"""A self-contained HTML page of a result: sections, tables and inline SVG, from banked evidence alone."""

from __future__ import annotations

from html import escape
from typing import Any

from sparkeda.model import AnalysisResult, jsonable

STYLE = "body{font:15px/1.5 system-ui,sans-serif;margin:2em auto;max-width:60em;color:#222}table{border-collapse:collapse;margin:.5em 0}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}.critical,.high{color:#a00}.medium{color:#850}svg{background:#f7f7f7}nav a{margin-right:1em}"


def bars(pairs: list[tuple[Any, float]], width: int = 480, height: int = 120) -> str:
    """Upright bars with a title each."""
    if not pairs:
        return ""
    top = max((v for _, v in pairs), default=0) or 1
    w = width / len(pairs)
    body = "".join(f'<rect x="{i * w:.1f}" y="{height - v / top * height:.1f}" width="{max(w - 1, 1):.1f}" height="{v / top * height:.1f}" fill="#4a7"><title>{escape(str(k))}: {v:g}</title></rect>' for i, (k, v) in enumerate(pairs))
    return f'<svg width="{width}" height="{height}" role="img">{body}</svg>'


def line(values: list[float], width: int = 480, height: int = 120) -> str:
    points = [(i, v) for i, v in enumerate(values) if v is not None]
    if len(points) < 2:
        return ""
    lo, hi = min(v for _, v in points), max(v for _, v in points)
    span, last = (hi - lo) or 1, points[-1][0] or 1
    path = " ".join(f"{i / last * width:.1f},{height - (v - lo) / span * height:.1f}" for i, v in points)
    return f'<svg width="{width}" height="{height}" role="img"><polyline points="{path}" fill="none" stroke="#269"/></svg>'


def dots(points: list[dict], width: int = 320, height: int = 220) -> str:
    """A scatter of the first two columns."""
    pairs = [tuple(p.values())[:2] for p in points]
    pairs = [(float(a), float(b)) for a, b in pairs if a is not None and b is not None]
    if not pairs:
        return ""
    xs, ys = zip(*pairs, strict=True)
    at = lambda v, all_, size: (v - min(all_)) / ((max(all_) - min(all_)) or 1) * size
    body = "".join(f'<circle cx="{at(a, xs, width):.1f}" cy="{height - at(b, ys, height):.1f}" r="2" fill="#269"/>' for a, b in pairs)
    return f'<svg width="{width}" height="{height}" role="img">{body}</svg>'


def heat(cells: list[dict], width: int = 320) -> str:
    """A matrix of strengths."""
    names = sorted({c["first"] for c in cells} | {c["second"] for c in cells})
    if not names:
        return ""
    w, at = width / len(names), {n: i for i, n in enumerate(names)}
    body = "".join(f'<rect x="{at[c["first"]] * w:.1f}" y="{at[c["second"]] * w:.1f}" width="{w:.1f}" height="{w:.1f}" fill="#269" fill-opacity="{(c["strength"] or 0):.2f}"><title>{escape(c["first"])} x {escape(c["second"])}: {c["strength"]}</title></rect>' for c in cells)
    return f'<svg width="{width}" height="{width}" role="img">{body}</svg>'


def paired(rows: list[tuple[Any, float, float]], width: int = 480, height: int = 120) -> str:
    """Two bars beside each other for each label: base and compared."""
    if not rows:
        return ""
    top = max(max(a, b) for _, a, b in rows) or 1
    w = width / len(rows) / 2
    body = ""
    for i, (k, *both) in enumerate(rows):
        for j, (v, colour) in enumerate(zip(both, ("#269", "#c73"), strict=True)):
            body += f'<rect x="{(2 * i + j) * w:.1f}" y="{height - v / top * height:.1f}" width="{max(w - 1, 1):.1f}" height="{v / top * height:.1f}" fill="{colour}"><title>{escape(str(k))}: {v:g}</title></rect>'
    return f'<svg width="{width}" height="{height}" role="img">{body}</svg>'


def band(r: dict, width: int = 320, height: int = 26) -> str:
    """A value beside the middle half and the median of its peers."""
    lo, hi = min(r["q1"], r["x"]), max(r["q3"], r["x"])
    at = lambda v: 8 + (v - lo) / ((hi - lo) or 1) * (width - 16)
    body = f'<rect x="{at(r["q1"]):.1f}" y="6" width="{max(at(r["q3"]) - at(r["q1"]), 1):.1f}" height="14" fill="#ccd"/><line x1="{at(r["median"]):.1f}" x2="{at(r["median"]):.1f}" y1="4" y2="22" stroke="#269"/><circle cx="{at(r["x"]):.1f}" cy="13" r="4" fill="#a00"/>'
    return f'<p><small>{escape(r["value"])} within {escape(r["condition"])}, {r["n_peers"]} peers</small></p><svg width="{width}" height="{height}" role="img">{body}</svg>'


def network(drawing: dict, width: int = 640, step: int = 90) -> str:
    """Tables in layers, parents above, with a line for each relationship."""
    layers: dict[int, list[dict]] = {}
    for n in sorted(drawing["nodes"], key=lambda n: (n["layer"], n["place"])):
        layers.setdefault(n["layer"], []).append(n)
    at = {n["table"]: ((i + 0.5) * width / len(row), 25 + k * step) for k, row in layers.items() for i, n in enumerate(row)}
    lines = "".join(f'<line x1="{at[e["child"]][0]:.0f}" y1="{at[e["child"]][1]:.0f}" x2="{at[e["parent"]][0]:.0f}" y2="{at[e["parent"]][1]:.0f}" stroke="#888"><title>{escape(e["child"])}.{escape(e["child_key"])} to {escape(e["parent"])}.{escape(e["parent_key"])}, {e["cardinality"]}</title></line>' for e in drawing["edges"])
    boxes = "".join(f'<rect x="{x - 55:.0f}" y="{y - 14:.0f}" width="110" height="28" fill="#fff" stroke="#269"/><text x="{x:.0f}" y="{y + 4:.0f}" font-size="12" text-anchor="middle">{escape(t)}</text>' for t, (x, y) in at.items())
    return f'<svg width="{width}" height="{50 + step * max(layers, default=0)}" role="img">{lines}{boxes}</svg>'


def chart(kind: str, value: Any) -> str:
    if kind == "profile_distribution":
        return bars([(h["bin"], h["n"]) for h in sorted(value["histogram"], key=lambda h: h["bin"])])
    if kind == "profile_category_frequency":
        return bars([(f["label"], f["n"]) for f in value])
    if kind == "profile_timeline":
        return line([p["n"] for p in sorted(value, key=lambda p: p["period"])])
    if kind == "profile_association_matrix":
        return heat(value)
    if kind == "profile_scatter":
        return dots(value)
    if kind == "time_series_autocorrelation":
        return bars([(a["lag"], abs(a["acf"] or 0)) for a in sorted(value["acf"], key=lambda a: a["lag"])])
    if kind == "column_comparison_chart" and "bins" in value:
        return paired([(b["bin"], b["n_base"], b["n_compare"]) for b in sorted(value["bins"], key=lambda b: b["bin"])])
    if kind == "column_comparison_chart" and "bars" in value:
        return paired([(b["label"], b["n_base"], b["n_compare"]) for b in value["bars"]])
    if kind == "clustering_k_sweep":
        return bars([(f"k={s['k']}", max(s["silhouette"], 0)) for s in value])
    if kind == "clustering_silhouette_by_segment":
        return bars([(f"segment {s['label']}", max(s["silhouette"] or 0, 0)) for s in value])
    if kind == "classification_target_summary":
        return bars([(c["label"], c["n"]) for c in value])
    if kind == "anomaly_row_explanations":
        return "".join(f"<p>{escape(r['why'])}</p>" + bars([(c["column"], abs(c["z"])) for c in r["contributors"]], height=50) for r in value)
    if kind == "anomaly_conditional_examples":
        return "".join(band(r) for r in value[:12])
    if kind in ("anomaly_isolation_forest", "anomaly_local_density"):
        return bars([(i, r.get("score", r.get("lof"))) for i, r in enumerate(sorted(value, key=lambda r: -r.get("score", r.get("lof", 0))))])
    if kind in ("clustering_projection", "regression_residual_scatter", "anomaly_scatter"):
        names = ("x", "y")
        return dots([{n: r[n] for n in names} for r in value])
    if kind == "regression_residual_shape":
        return bars([(b["bin"], abs(b["std"] or 0)) for b in sorted(value["bins"], key=lambda b: b["bin"])])
    if kind == "regression_influence":
        return bars([(i, r["cook"]) for i, r in enumerate(value)])
    if kind in ("time_series_gaps", "time_series_blanks"):
        return bars([(i, f["n_periods"]) for i, f in enumerate(value)], height=60)
    if kind == "image_label_profile":
        return bars([(r["label"], r["n"]) for r in value])
    if kind == "schema_graph":
        return network(value["drawing"])
    return ""


def table(rows: Any) -> str:
    rows = rows if isinstance(rows, list) else [rows]
    rows = [r if isinstance(r, dict) else {"value": r} for r in rows[:50]]
    heads = list(dict.fromkeys(k for r in rows for k in r))
    body = "".join("<tr>" + "".join(f"<td>{escape(str(r.get(h, '')))[:200]}</td>" for h in heads) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in heads) + f"</tr>{body}</table>"


def sections(result: AnalysisResult) -> list[tuple[str, str]]:
    """(title, html) in order; empty ones are left out."""
    plain = result.to_dict()
    found = lambda fs: "".join(f'<p><b class="{f.severity}">{f.severity}</b> {escape(f.title)} <small>{", ".join(f.evidence_ids)}</small></p>' for f in fs)
    groups: dict[str, str] = {}
    for e in plain["evidence"]:
        title = " ".join(filter(None, [e["kind"].replace("_", " "), e["table"], ", ".join(e["columns"])]))
        groups[e["kind"]] = groups.get(e["kind"], "") + f'<h4 id="{e["id"]}">{escape(title)}</h4>{chart(e["kind"], e["value"])}{table(e["value"])}'
    out = [("Summary", f"<p>{escape(result.summary)} ({result.status})</p>"), ("Issues", found(result.issues)), ("Observations", found(result.observations))]
    out += [(k.replace("_", " ").capitalize(), v) for k, v in groups.items()]
    out += [("Recommended steps", table(plain["plan"]) if plain["plan"] else ""), ("Sampling", table(plain["sampling"]) if plain["sampling"] else ""), ("Warnings", table(plain["warnings"]) if plain["warnings"] else ""), ("Failures", table(plain["failures"]) if plain["failures"] else "")]
    return [(t, h) for t, h in out if h]


def render(result: AnalysisResult, interactive: bool = False) -> str:
    parts = sections(result)
    nav = "".join(f'<a href="#s{i}">{i}. {escape(t)}</a>' for i, (t, _) in enumerate(parts, 1))
    body = "".join(f'<section id="s{i}"><h2>{i}. {escape(t)}</h2>{h}</section>' for i, (t, h) in enumerate(parts, 1))
    note = "<p>Charts are static.</p>" if interactive else ""
    title = escape(str(jsonable(result.goal)))
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>{STYLE}</style></head><body><h1>{title}</h1>{note}<nav>{nav}</nav>{body}</body></html>'
