"""Associations between columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.columns import edge_bin, finite
from sparkeda.functions.ordered import backward_steps, column_quantiles, running


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells (a, b, n) of complete pairs that occur."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def chi_squared(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, rows, cols, chi2: from the cells that occur and their margins, n * (sum n_ij^2 / (n_i n_j) - 1)."""
    cells = contingency(df, a, b)
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    both = cells.join(left, "a").join(right, "b")
    out = both.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.count_distinct("a").alias("rows"), F.count_distinct("b").alias("cols"))
    return out.select("n", "rows", "cols", (F.col("n") * (F.col("s") - 1)).alias("chi2"))


def cramers_v(df: DataFrame, a: str, b: str, corrected: bool = True, min_rows: int = 20) -> DataFrame:
    """Cramer's V, bias-corrected (Bergsma) or raw; NULL under min_rows or for a table of one row or column."""
    x = chi_squared(df, a, b)
    n, r, c = F.col("n"), F.col("rows"), F.col("cols")
    phi2 = F.col("chi2") / n
    if corrected:
        phi2 = F.greatest(F.lit(0.0), phi2 - (c - 1) * (r - 1) / (n - 1))
        r, c = r - (r - 1) * (r - 1) / (n - 1), c - (c - 1) * (c - 1) / (n - 1)
    least = F.least(r, c) - 1
    v = F.when((F.col("rows") >= 2) & (F.col("cols") >= 2) & (n >= min_rows) & (least > 0), F.least(F.lit(1.0), F.sqrt(phi2 / least)))
    return x.select(F.lit(a).alias("first"), F.lit(b).alias("second"), "n", F.round(v, 6).alias("strength"))


def eta_squared(df: DataFrame, value: str, group: str, min_rows: int = 3, digits: int = 6) -> DataFrame:
    """Between over total sum of squares of complete pairs: n, groups, eta2."""
    rows = df.select(F.col(group).cast("string").alias("g"), finite(value).alias("x")).where("g IS NOT NULL AND x IS NOT NULL")
    by = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    whole = by.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    parts = by.join(F.broadcast(whole)).agg(F.first("total").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    eta2 = F.when((F.col("n") >= min_rows) & (F.col("groups") >= 2) & (F.col("between") + F.col("within") > 0), F.least(F.lit(1.0), F.col("between") / (F.col("between") + F.col("within"))))
    return parts.select(F.lit(value).alias("value"), F.lit(group).alias("group"), "n", "groups", F.round(eta2, digits).alias("eta2"))


def correlation_ratio(df: DataFrame, value: str, group: str) -> DataFrame:
    """eta, the root of eta_squared, from 20 rows and two groups."""
    return eta_squared(df, value, group, 20, 15).select("value", "group", "n", F.round(F.sqrt("eta2"), 5).alias("eta"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair over its complete rows; one aggregate for all pairs."""
    x = df.select(*[finite(c).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = x.agg(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"), F.corr(a, b).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return out.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))]))).withColumn("r", F.round("r", 6))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """value -> rank, ties sharing their average; over distinct values with their counts, not over rows."""
    c = df.select(finite(column).alias(column)).where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return running(c, column, "n").select(column, (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2).alias(name))


def _ranked_pearson(x: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of the ranks of rows without NULLs: ranks are joined back by value."""
    out = x
    for c in columns:
        out = out.join(average_ranks(x, c, f"rank_{c}"), c)
    return pearson(out.select(*[F.col(f"rank_{c}").alias(c) for c in columns]), columns).withColumnRenamed("r", "rho")


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman correlation of each pair over the rows in which both are there.

    Columns without a NULL are ranked once for all their pairs; a pair with NULLs has ranks of its own.
    """
    x = df.select(*[finite(c).alias(c) for c in columns])
    holes = x.agg(*[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    full = [c for i, c in enumerate(columns) if not holes[f"m{i}"]]
    parts = [_ranked_pearson(x.select(*full), full)] if len(full) > 1 else []
    for i, a in enumerate(columns):
        parts += [_ranked_pearson(x.select(a, b).dropna(), [a, b]) for b in columns[i + 1 :] if a not in full or b not in full]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def association_matrix(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Strength in [0, 1] of every pair: |Spearman|, bias-corrected V, or eta."""
    out = spearman(df, numeric).select("first", "second", F.abs("rho").alias("strength"), F.lit("spearman").alias("method")) if len(numeric) > 1 else None
    parts = [cramers_v(df, a, b).select("first", "second", "strength", F.lit("cramers_v").alias("method")) for i, a in enumerate(categorical) for b in categorical[i + 1 :]]
    parts += [correlation_ratio(df, n, c).select(F.col("value").alias("first"), F.col("group").alias("second"), F.col("eta").alias("strength"), F.lit("correlation_ratio").alias("method")) for n in numeric for c in categorical]
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: `edges`, strictly increasing quantiles."""
    marks = column_quantiles(df, [column], [i / bins for i in range(bins + 1)])[0]
    return df.sparkSession.createDataFrame([(sorted({m for m in marks if m is not None}),)], "edges array<double>")


def binned_eta_squared(df: DataFrame, feature: str, target: str, bins: int = 10) -> DataFrame:
    """eta squared of the target over quantile bins [a, b) of the feature; needs three bins' edges."""
    rows = df.select(finite(feature).alias("f"), finite(target).alias("t")).where("f IS NOT NULL AND t IS NOT NULL")
    edges = quantile_edges(rows, "f", bins)
    binned = rows.join(F.broadcast(edges)).where(F.size("edges") >= 3).select(edge_bin(F.col("f"), F.col("edges")).alias("bin"), "t")
    return eta_squared(binned, "t", "bin", 20).select(F.lit(feature).alias("feature"), F.lit(target).alias("target"), "n", F.col("groups").alias("bins"), "eta2")



def rule_accuracy(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Accuracy of predicting a row's most frequent target by its feature value: n, n_values, accuracy."""
    cells = contingency(df, feature, target)
    best = cells.groupBy("a").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"), F.sum("best").alias("right")).select(F.lit(feature).alias("feature"), "n", "n_values", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"))


def time_coverage(df: DataFrame, column: str, order: str) -> DataFrame:
    """Span, median positive gap, gaps above three medians, and the steps back in time when rows come by `order` (an integer key)."""
    t = df.where(F.col(column).isNotNull()).select(F.unix_micros(F.col(column).cast("timestamp")).alias("t"), F.col(order).alias("o"))
    gaps = running(t.select("t").distinct(), "t").select("t", (F.col("next") - F.col("t")).alias("gap"))
    typical = gaps.agg(F.percentile("gap", 0.5).alias("typical"))
    wide = gaps.join(F.broadcast(typical)).agg(F.count_if(F.col("gap") > 3 * F.col("typical")).alias("n_wide_gaps"), F.max("gap").alias("max_gap"), F.first("typical").alias("typical"), F.count(F.lit(1)).alias("n_distinct"))
    rows = t.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    back = backward_steps(t, "o", "t")
    return rows.join(F.broadcast(wide)).join(F.broadcast(back)).select("n", "n_distinct", F.round((F.col("hi") - F.col("lo")) / 86400e6, 6).alias("span_days"), F.round(F.col("typical") / 1e6, 3).alias("median_gap_s"), F.round(F.col("max_gap") / 1e6, 3).alias("max_gap_s"), "n_wide_gaps", "n_backward")
