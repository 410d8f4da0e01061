"""Column expressions that operators share. All are JVM-side and null-safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a whole numeric text looks; try_cast alone would also take '12d' or ' 3 '.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def family(dtype: T.DataType) -> str:
    """boolean, datetime, numeric, string or nested."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "string" if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)) else "nested"


def columns_of(df: DataFrame, *families: str) -> list[str]:
    return [f.name for f in df.schema if family(f.dataType) in families]


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, as a missing value is a NULL everywhere else."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def finite(c: str | Column) -> Column:
    """The value as double; NULL for NaN and infinities."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def stripped(c: str | Column) -> Column:
    """Without white space at either end (trim takes blanks only)."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")


def folded(c: str | Column) -> Column:
    return F.lower(stripped(c))


def number_of(c: str | Column) -> Column:
    """Text as a double, NULL where it is no number."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.rlike(NUMBER_TEXT), stripped(x).try_cast("double"))


def adjusted_skew(c: str | Column, n: Column) -> Column:
    """Bias-adjusted skewness (Spark's is the population one); needs 3 rows."""
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(c: str | Column, n: Column) -> Column:
    """Bias-adjusted excess kurtosis; needs 4 rows."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def robust_ladder(x: Column, median: Column, mad: Column, iqr: Column, mean: Column, std: Column) -> Column:
    """Robust z: by MAD, else by IQR, else by the standard deviation, else 0."""
    return F.when(mad > 0, (x - median) * 0.6745 / mad).when(iqr > 0, (x - median) / (iqr / 1.349)).when(std > 0, (x - mean) / std).otherwise(F.when(x.isNotNull(), 0.0))


def equal_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of equal width, the last one closed."""
    return F.when(high > low, F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))).otherwise(0).cast("int")


def edge_bin(x: Column, edges: Column) -> Column:
    """How many inner edges are at or below x: bins [a, b) between ascending, distinct edges, the last closed."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= x))


def hash_order(seed: int, columns: Sequence[str]) -> Column:
    """A seeded order that does not depend on partitions; ties need a key after it."""
    return F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in columns])
