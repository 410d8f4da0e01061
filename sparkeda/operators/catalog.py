"""Catalogue: exact facts of tables and their columns (CA1-CA16)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkeda.functions.columns import adjusted_kurtosis, adjusted_skew, columns_of, family, finite, normalise
from sparkeda.functions.ordered import column_quantiles


def semantic_type(kind: Column, n_distinct: Column, n_values: Column) -> Column:
    """boolean, datetime, numeric by type; strings are categorical with at most 50 values, or 200 that are at most 5 %."""
    return F.when(kind.isin("boolean", "datetime", "numeric"), kind).when((n_distinct <= 50) | ((n_distinct <= 200) & (n_distinct <= 0.05 * n_values)), "categorical").otherwise("text")


def roles(low: Column, kind: Column, semantic: Column, unique_rate: Column, n_missing: Column) -> Column:
    """Roles by lower-case name, type and facts, comma-joined."""
    out = [
        F.when((kind == "datetime") | low.contains("date") | low.contains("time"), "timestamp_candidate"),
        F.when(((low == "id") | low.endswith("_id") | low.contains("identifier")) & (unique_rate >= 0.98) & (n_missing == 0), "identifier_candidate"),
        F.when(kind == "numeric", "measure_candidate"),
        F.when(semantic.isin("categorical", "boolean"), "dimension_candidate"),
        F.when(semantic == "text", "free_text_candidate"),
    ]
    return F.concat_ws(",", F.array_compact(F.array(*out)))


def distinct_counts(df: DataFrame) -> DataFrame:
    """(i, n_values, n_distinct) of every column, NULL excluded, from one long table of values with partial counts.

    A value's text stands for it; -0.0 is 0.0, as when grouping.
    """
    text = [(F.col(f"`{f.name}`") + F.lit(0.0) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`")) if family(f.dataType) != "nested" else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema]
    missing = [F.col(f"`{c}`").isNull() for c in df.columns]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.when(~m, t.cast("string")).alias("v")) for i, (t, m) in enumerate(zip(text, missing, strict=True))])
    counts = df.select(F.inline(cells)).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("i").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"), F.count("v").alias("n_distinct"))


def column_catalog(df: DataFrame, table: str) -> DataFrame:
    """One row per column, from one scan whatever the number of columns.

    Returns table, column, kind, n_rows, n_missing, missing_rate, n_distinct (NULL excluded),
    unique_rate, semantic_type, roles, warnings.
    """
    df = normalise(df)
    kinds = df.sparkSession.createDataFrame([(i, f.name, family(f.dataType), f.name.lower()) for i, f in enumerate(df.schema)], "i int, `column` string, kind string, low string")
    counted = F.broadcast(kinds).join(distinct_counts(df), "i", "left").na.fill(0, ["n_rows", "n_values", "n_distinct"]) if df.columns else kinds.selectExpr("*", "0L AS n_rows", "0L AS n_values", "0L AS n_distinct")
    n, v, d, kind = F.col("n_rows"), F.col("n_values"), F.col("n_distinct"), F.col("kind")
    unique, missing = F.coalesce(F.try_divide(d, v), F.lit(0.0)), F.coalesce(F.try_divide(n - v, n), F.lit(0.0))
    out = counted.withColumn("semantic_type", semantic_type(kind, d, v))
    sem = F.col("semantic_type")
    warnings = F.concat_ws(",", F.array_compact(F.array(F.when(missing >= 0.5, "mostly_missing"), F.when((d <= 1) & (v > 0), "constant"), F.when((sem == "categorical") & (d > 100), "high_cardinality"))))
    return out.select(F.lit(table).alias("table"), "column", "kind", "n_rows", (n - v).alias("n_missing"), F.round(missing, 6).alias("missing_rate"), "n_distinct", F.round(unique, 6).alias("unique_rate"), "semantic_type", roles(F.col("low"), kind, sem, unique, n - v).alias("roles"), warnings.alias("warnings"))


def table_catalog(df: DataFrame, table: str) -> DataFrame:
    """n_rows, n_columns, n_duplicates (rows after the first of equal ones; NULLs are equal), n_missing cells."""
    df = normalise(df)
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    missing = sum((F.when(F.col(c).isNull(), F.col("_n")).otherwise(0) for c in df.columns), F.lit(0))
    return rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("n_duplicates"), F.coalesce(F.sum(missing), F.lit(0)).alias("n_missing")).select(
        F.lit(table).alias("table"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_duplicates", "n_missing"
    )


def numeric_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column: moments (sample standard deviation, adjusted skewness and kurtosis), exact quantiles, counts of zero, negative and infinite values."""
    columns = columns or columns_of(df, "numeric")
    clean = df.select(*[finite(c).alias(c) for c in columns], *[F.when(F.abs(F.col(c).cast("double")) == float("inf"), 1).alias(f"{c}\u0001inf") for c in columns])
    cells = []
    for i, c in enumerate(columns):
        x, n = F.col(f"`{c}`"), F.count(f"`{c}`")
        cells.append(F.struct(F.lit(c).alias("column"), n.alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), adjusted_skew(x, n).alias("skew"), adjusted_kurtosis(x, n).alias("kurtosis"), F.count_if(x == 0).alias("n_zero"), F.count_if(x < 0).alias("n_negative"), F.count(F.col(f"`{c}\u0001inf`")).alias("n_infinite")))
    rows = clean.agg(*[c.alias(f"s{i}") for i, c in enumerate(cells)]).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))
    marks = column_quantiles(df, columns, [0.05, 0.25, 0.5, 0.75, 0.95])
    marks = df.sparkSession.createDataFrame([(c, *q) for c, q in zip(columns, marks, strict=True)], "column string, " + ", ".join(f"{p} double" for p in ("p5", "q1", "median", "q3", "p95")))
    r = lambda c: F.round(c, 4).alias(c)
    return rows.join(F.broadcast(marks), "column").select("column", "n", r("min"), r("max"), r("mean"), r("std"), *[r(p) for p in ("p5", "q1", "median", "q3", "p95")], r("skew"), r("kurtosis"), "n_zero", "n_negative", "n_infinite")


def datetime_statistics(df: DataFrame, column: str) -> DataFrame:
    t = F.col(column).cast("timestamp_ntz")
    return df.agg(F.count(column).alias("n"), F.min(t).alias("min"), F.max(t).alias("max"), F.count_distinct(t).alias("n_distinct"))


def text_statistics(df: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return df.agg(F.count(column).alias("n"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(n), 4).alias("mean_length"))


def top_values(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """Most frequent values, NULL among them; ties by value, NULL last."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(limit)


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that occur more than once, with their number."""
    columns = columns or df.columns
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def head_and_tail(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """The first and last rows by explicit keys (a DataFrame has no order of its own)."""
    head = df.orderBy(*order).limit(size).withColumn("part", F.lit("head"))
    return head.unionByName(df.orderBy(*[F.desc(c) for c in order]).limit(size).withColumn("part", F.lit("tail")))


def seeded_sample(df: DataFrame, size: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly `size` rows (or all), chosen by a seeded hash of the key: the same whatever the partitions."""
    from sparkeda.functions.columns import hash_order

    return df.orderBy(hash_order(seed, key), *key).limit(size)


def fingerprint(df: DataFrame) -> str:
    """sha256 over the schema, the row count and order-insensitive folds of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    got = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(2**31 - 1))), F.lit(0))).first()
    return hashlib.sha256(f"{df.schema.json()}|{tuple(got)}".encode()).hexdigest()


def dataset_fingerprint(fingerprints: dict[str, str]) -> str:
    return hashlib.sha256("|".join(f"{k}={v}" for k, v in sorted(fingerprints.items())).encode()).hexdigest()


def feature_admission(df: DataFrame, target: str | None, max_categories: int = 50, limit: int = 30) -> DataFrame:
    """Which columns a model may use and why not: column, use ('numeric', 'categorical' or 'none'), reason."""
    cat = column_catalog(df.drop(target) if target else df, "t")
    reason = (
        F.when(F.col("n_missing") == F.col("n_rows"), "all_missing").when(F.col("n_distinct") <= 1, "constant").when(F.col("roles").contains("identifier_candidate"), "identifier")
        .when(F.col("kind") == "datetime", "datetime").when((F.col("kind") != "numeric") & (F.col("n_distinct") > max_categories), "high_cardinality")
    )
    use = F.when(reason.isNotNull(), "none").when(F.col("kind") == "numeric", "numeric").otherwise("categorical")
    return cat.select("column", use.alias("use"), F.coalesce(reason, F.lit("")).alias("reason"))
