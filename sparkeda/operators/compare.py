"""Side-by-side comparison of two datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.columns import columns_of, equal_bin, finite
from sparkeda.functions.ordered import column_quantiles


def common_columns(base: DataFrame, other: DataFrame) -> tuple[list[str], list[str]]:
    """(columns numeric on either side, the others), sorted, of those both have."""
    both = sorted(set(base.columns) & set(other.columns))
    numeric = set(columns_of(base, "numeric")) | set(columns_of(other, "numeric"))
    return [c for c in both if c in numeric], [c for c in both if c not in numeric]


def numeric_histograms(base: DataFrame, other: DataFrame, column: str, bins: int = 24) -> DataFrame:
    """Rows of both sides in bins with shared edges: one pass over the union."""
    x = lambda df, side: df.select(finite(F.col(column).try_cast("double")).alias("x"), F.lit(side).alias("side"))
    both = x(base, "base").unionByName(x(other, "compare")).where("x IS NOT NULL")
    ends = both.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    binned = both.join(F.broadcast(ends)).groupBy(equal_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
    return binned.agg(F.count_if(F.col("side") == "base").alias("n_base"), F.count_if(F.col("side") == "compare").alias("n_compare"))


def numeric_summary(df: DataFrame, column: str, side: str) -> DataFrame:
    x = finite(F.col(column).try_cast("double"))
    got = df.agg(F.count(x).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    marks = column_quantiles(df.select(x.alias("x")), ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])[0]
    return got.select(F.lit(side).alias("side"), "n", "missing", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), *[F.round(F.lit(q).cast("double"), 4).alias(k) for k, q in zip(("min", "q1", "median", "q3", "max"), marks, strict=True)])


def category_counts(base: DataFrame, other: DataFrame, column: str, top: int = 15) -> DataFrame:
    """Rows of both sides of the labels that are among either side's `top`; NULL is the label nan."""
    label = F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("label")
    a, b = (df.groupBy(label).agg(F.count(F.lit(1)).alias(n)) for df, n in ((base, "n_base"), (other, "n_compare")))
    keep = a.orderBy(F.desc("n_base"), "label").limit(top).select("label").unionByName(b.orderBy(F.desc("n_compare"), "label").limit(top).select("label")).distinct()
    return a.join(b, "label", "full").join(F.broadcast(keep), "label").select("label", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.coalesce("n_compare", F.lit(0)).alias("n_compare"))


def category_summary(df: DataFrame, column: str, side: str) -> DataFrame:
    c = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("v"))
    return c.agg(F.sum("v").alias("n"), F.sum(F.col("n") - F.col("v")).alias("missing"), F.count(F.lit(1)).alias("n_labels"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("top"), F.max("n").alias("top_n")).select(F.lit(side).alias("side"), "*")
