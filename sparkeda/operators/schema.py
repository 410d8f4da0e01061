"""Keys and relationships."""

from __future__ import annotations

import difflib
import re
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.columns import family

# Tokens of key names and their scores.
KEY_TOKENS = frozenset({"key", "uuid", "guid"})
CODE_TOKENS = frozenset({"account", "code", "email", "isbn", "no", "number", "serial", "sku", "username"})


def tokens(name: str) -> list[str]:
    """Lower-case words of a name, camel case parted."""
    return [t for t in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if t]


def singular(word: str) -> str:
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def name_score(table: str, column: str) -> float:
    """How much a name looks like a key: 1 for id or <table>_id, .8 for *_id or a key word, .65 for a code word, else .2."""
    parts = tokens(column)
    name, own = "_".join(parts), "_".join(singular(t) for t in tokens(table))
    if name in ("id", f"{own}_id", f"{'_'.join(tokens(table))}_id"):
        return 1.0
    if name.endswith("_id") or "identifier" in parts or KEY_TOKENS & set(parts):
        return 0.8
    return 0.65 if CODE_TOKENS & set(parts) else 0.2


def plausible_key(df: DataFrame, table: str, columns: tuple[str, ...]) -> bool:
    scores = [name_score(table, c) for c in columns]
    kinds = [family(df.schema[c].dataType) for c in columns]
    return sum(scores) / len(scores) >= 0.5 and all(s >= 0.5 or k == "string" for s, k in zip(scores, kinds, strict=True))


def key_metrics(df: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """Completeness (rows with all columns set) and uniqueness (distinct of those) of several keys in one aggregate."""
    cells = []
    for i, key in enumerate(keys):
        full = F.lit(True)
        for c in key:
            full = full & F.col(c).isNotNull()
        cells += [F.count_if(full).alias(f"c{i}"), F.count_distinct(F.when(full, F.struct(*key))).alias(f"d{i}")]
    got = df.agg(F.count(F.lit(1)).alias("n"), *cells)
    rows = [F.struct(F.lit(",".join(key)).alias("key"), F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_complete"), F.col(f"d{i}").alias("n_distinct"), F.round(F.coalesce(F.try_divide(f"c{i}", "n"), F.lit(0.0)), 6).alias("completeness"), F.round(F.coalesce(F.try_divide(f"d{i}", f"c{i}"), F.lit(0.0)), 6).alias("uniqueness")) for i, key in enumerate(keys)]
    return got.select(F.inline(F.array(*rows)))


def key_candidates(df: DataFrame, table: str, max_columns: int = 2, min_uniqueness: float = 0.98, min_completeness: float = 0.98, limit: int | None = None) -> list[dict]:
    """Level-wise search: one aggregate a width, supersets of keys found are left out. All columns take part; `limit` keeps the likeliest."""
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(df.columns)], *[F.count(c).alias(f"v{i}") for i, c in enumerate(df.columns)]).first()
    ranked = sorted(((-(counts[f"d{i}"] / counts[f"v{i}"]) - c.lower().endswith("_id"), c) for i, c in enumerate(df.columns) if counts[f"d{i}"] > 1))
    names, found = [c for _, c in ranked[:limit]], []
    for width in range(1, max_columns + 1):
        keys = [k for k in combinations(names, width) if plausible_key(df, table, k) and not any(set(f["key"].split(",")) <= set(k) for f in found)]
        for r in key_metrics(df, keys).collect() if keys else []:
            if r["uniqueness"] >= min_uniqueness and r["completeness"] >= min_completeness:
                score = sum(name_score(table, c) for c in r["key"].split(",")) / width
                found.append(r.asDict() | {"table": table, "name_score": score, "confidence": round(0.55 * r["uniqueness"] + 0.30 * r["completeness"] + 0.15 * score, 6)})
    return found


def name_similarity(parent: str, parent_columns: tuple[str, ...], child_columns: tuple[str, ...]) -> float:
    out = []
    for p, c in zip(parent_columns, child_columns, strict=True):
        a, b = "_".join(tokens(p)), "_".join(tokens(c))
        if a == b:
            out.append(1.0)
            continue
        both = set(tokens(p)) | set(tokens(c))
        own = "_".join(singular(t) for t in tokens(parent)) + "_id"
        out.append(max(len(set(tokens(p)) & set(tokens(c))) / len(both), 0.85 if b == own else 0.0, 0.75 * difflib.SequenceMatcher(None, a, b).ratio()))
    return sum(out) / len(out)


def type_compatibility(parent: DataFrame, parent_columns: tuple[str, ...], child: DataFrame, child_columns: tuple[str, ...]) -> float:
    out = []
    for p, c in zip(parent_columns, child_columns, strict=True):
        kinds = {family(parent.schema[p].dataType), family(child.schema[c].dataType)}
        out.append(1.0 if len(kinds) == 1 else 0.25 if kinds == {"numeric", "string"} else 0.0)
    return sum(out) / len(out)


def relationship_metrics(parent: DataFrame, parent_columns: tuple[str, ...], child: DataFrame, child_columns: tuple[str, ...]) -> DataFrame:
    """Inclusion of distinct child keys, coverage of child rows, orphans, parents without a child, child uniqueness.

    Child rows are counted by key before the one full outer join, so a hot key is one row there.
    """
    names = [f"k{i}" for i in range(len(parent_columns))]
    keyed = lambda df, cols: df.select(*[F.col(c).alias(k) for c, k in zip(cols, names, strict=True)]).dropna()
    kids = keyed(child, child_columns).groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    both = kids.join(keyed(parent, parent_columns).distinct().withColumn("in_parent", F.lit(1)), names, "full")
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    out = both.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("child_rows"), F.count("rows").alias("child_keys"), F.count_if(F.col("rows").isNotNull() & F.col("in_parent").isNotNull()).alias("matched_keys"), F.coalesce(F.sum(F.when(F.col("in_parent").isNull(), F.col("rows"))), F.lit(0)).alias("orphan_rows"), F.count_if(F.col("rows").isNull()).alias("unreferenced_parents"))
    return out.select("child_rows", "child_keys", r("matched_keys", "child_keys").alias("inclusion"), r(F.col("child_rows") - F.col("orphan_rows"), "child_rows").alias("row_coverage"), "orphan_rows", "unreferenced_parents", r("child_keys", "child_rows").alias("child_uniqueness"))


def orphans(parent: DataFrame, parent_column: str, child: DataFrame, child_column: str) -> DataFrame:
    """Child rows without a parent."""
    keys = parent.select(F.col(parent_column).alias("_k")).distinct()
    return child.where(F.col(child_column).isNotNull()).join(keys, F.col(child_column) == F.col("_k"), "left_anti")


def likely_children(parent: DataFrame, table: str, key: tuple[str, ...], child: DataFrame, min_kind: float = 0.75, min_name: float = 0.2) -> list[tuple[tuple[str, ...], float, float]]:
    """(columns, name similarity, type compatibility) of every set of child columns that may refer to the key, each in its best order."""
    able = [f.name for f in child.schema if family(f.dataType) != "nested"]
    out = []
    for group in combinations(able, len(key)):
        rated = [(name_similarity(table, key, cols), type_compatibility(parent, key, child, cols), cols) for cols in permutations(group)]
        same, kind, cols = max(rated, key=lambda r: r[0] + r[1])
        if kind >= min_kind and same >= min_name:
            out.append((cols, same, kind))
    return out


def relationship_candidates(tables: dict[str, DataFrame], keys: list[dict], min_inclusion: float = 0.9, min_confidence: float = 0.72) -> list[dict]:
    """Every key against every set of columns of other tables whose types and names allow it, so a table may refer
    to one key several times (a billing and a shipping customer). Metrics are exact: one job for each
    key and child table, whatever the number of column sets."""
    out = []
    for key in keys:
        parent, cols = tables[key["table"]], tuple(key["key"].split(","))
        for name, child in tables.items():
            likely = [] if name == key["table"] else likely_children(parent, key["table"], cols, child)
            both = None
            for i, (kid, _, _) in enumerate(likely):
                one = relationship_metrics(parent, cols, child, kid).withColumn("i", F.lit(i))
                both = one if both is None else both.unionByName(one)
            for m in sorted(both.collect(), key=lambda r: r["i"]) if likely else []:
                kid, same, kind = likely[m["i"]]
                one_to_one = m["child_uniqueness"] >= 1
                effective = m["inclusion"]
                if not one_to_one and same < 0.6:
                    effective *= min(1.0, m["child_keys"] / max(1, m["child_keys"] + m["unreferenced_parents"]))
                confidence = min(1.0, 0.5 * effective + 0.18 * kind + 0.17 * same + 0.15 * key["confidence"])
                if m["inclusion"] >= min_inclusion and confidence >= min_confidence and not (one_to_one and same < 0.6):
                    facts = {k: v for k, v in m.asDict().items() if k != "i"}
                    out.append(facts | {"parent": key["table"], "parent_key": key["key"], "child": name, "child_key": ",".join(kid), "confidence": round(confidence, 6), "cardinality": "one_to_one" if one_to_one else "one_to_many"})
    return out


def graph_roles(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Role of each table from its links (child, parent): n_parents, n_children, role."""
    up = edges.groupBy(F.col("child").alias("table")).agg(F.count_distinct("parent").alias("n_parents"))
    down = edges.groupBy(F.col("parent").alias("table")).agg(F.count_distinct("child").alias("n_children"))
    t = tables.join(up, "table", "left").join(down, "table", "left").na.fill(0)
    size = tables.agg(F.greatest(F.lit(3), F.ceil(F.lit(0.4) * F.count(F.lit(1)))).alias("hub"))
    p, c = F.col("n_parents"), F.col("n_children")
    role = F.when(p + c == 0, "standalone").when(p + c >= F.col("hub"), "hub").when((p >= 2) & (c == 0), "junction").when((p > 0) & (c > 0), "bridge").when(c > 0, "dimension").otherwise("fact")
    return t.join(F.broadcast(size)).select("table", p, c, role.alias("role"))


def pagerank(nodes: list[str], edges: list[tuple[str, str]], damping: float = 0.85, rounds: int = 60) -> dict[str, float]:
    """Importance of tables, children voting for parents; tables are few, so this stays on the driver."""
    n = len(nodes)
    rank = dict.fromkeys(nodes, 1 / n) if n else {}
    out = {v: [p for c, p in edges if c == v] for v in nodes}
    for _ in range(rounds):
        loose = sum(rank[v] for v in nodes if not out[v])
        new = dict.fromkeys(nodes, (1 - damping) / n + damping * loose / n) if n else {}
        for v in nodes:
            for p in out[v]:
                new[p] += damping * rank[v] / len(out[v])
        rank = new
    return rank


def layers(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """Depth of each table below the tables without a parent; tables on a cycle keep the depth reached."""
    depth = dict.fromkeys(nodes, 0)
    for _ in nodes:
        changed = False
        for child, parent in edges:
            if depth[child] < depth[parent] + 1 <= len(nodes):
                depth[child], changed = depth[parent] + 1, True
        if not changed:
            break
    return {v: min(d, max(0, len(nodes) - 1)) for v, d in depth.items()}


def ordered_layers(depth: dict[str, int], edges: list[tuple[str, str]], sweeps: int = 4) -> list[list[str]]:
    """Tables by layer, each layer in the order of its members' mean neighbour place, swept down and up, so that fewer links cross."""
    rows = [sorted(t for t, d in depth.items() if d == k) for k in range(max(depth.values(), default=-1) + 1)]
    near: dict[str, list[str]] = {t: [] for t in depth}
    for child, parent in edges:
        near[child].append(parent)
        near[parent].append(child)
    for sweep in range(sweeps):
        for k in range(len(rows)) if sweep % 2 == 0 else reversed(range(len(rows))):
            place = {t: i for row in rows for i, t in enumerate(row)}
            other = {t: [place[x] for x in near[t] if depth[x] != k] for t in rows[k]}
            rows[k].sort(key=lambda t: (sum(other[t]) / len(other[t]) if other[t] else place[t], t))
    return rows


def graph_chart(tables: list[str], roles: list[dict], importance: dict[str, float], depth: dict[str, int], links: list[dict]) -> dict:
    """Nodes with role, importance and place, and edges with their keys: what a drawing of the schema needs."""
    by = {r["table"]: r for r in roles}
    rows = ordered_layers(depth, [(r["child"], r["parent"]) for r in links])
    place = {t: (k, i) for k, row in enumerate(rows) for i, t in enumerate(row)}
    nodes = [{"table": t, "role": by[t]["role"] if t in by else "standalone", "importance": round(importance.get(t, 0.0), 6), "layer": place[t][0], "place": place[t][1]} for t in sorted(tables)]
    return {"nodes": nodes, "edges": [{k: r[k] for k in ("child", "child_key", "parent", "parent_key", "cardinality", "confidence")} for r in links]}


def schema_verdict(n_tables: int, links: list[dict], roles: list[dict]) -> str:
    """One sentence: how the tables hang together, and what to look at first."""
    if not links:
        return f"{n_tables} tables, no relationship between them passes"
    alone = sorted(r["table"] for r in roles if r["role"] == "standalone")
    orphans = [r for r in links if r["orphan_rows"]]
    out = f"{n_tables} tables, {len(links)} relationship(s)"
    hubs = sorted(r["table"] for r in roles if r["role"] == "hub")
    out += f", around {', '.join(hubs)}" if hubs else ""
    out += f"; {', '.join(alone)} stand(s) alone" if alone else ""
    if orphans:
        worst = max(orphans, key=lambda r: r["orphan_rows"])
        out += f"; {worst['orphan_rows']:,} rows of {worst['child']}.{worst['child_key']} have no {worst['parent']}"
    return out
