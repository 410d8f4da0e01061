"""Data-quality checks (Q1-Q11, P2, B9): exact over all rows, each one aggregate or one group-by."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.columns import family, folded, number_of, stripped

# Texts that stand for a missing value.
MISSING_TOKENS = ("", "-", "--", "?", "??", ".", "n/a", "n.a.", "na", "nan", "nil", "none", "null", "missing", "unknown", "undefined", "not available", "not applicable", "#n/a", "#null!", "tbd")
# Numbers and dates that stand for a missing value.
NUMERIC_SENTINELS = (-999.0, -9999.0, -99999.0, -999999.0)
DATE_SENTINELS = ("1970-01-01", "1900-01-01", "1899-12-30", "2099-12-31")
# Names of the two ends of a range.
RANGE_TOKENS = (("start", "end"), ("start", "stop"), ("begin", "end"), ("from", "to"), ("open", "close"), ("created", "closed"), ("birth", "death"), ("hire", "termination"), ("first", "last"))
# Layouts of dates in text, the first that matches counts.
DATE_LAYOUTS = (
    ("iso_date", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("iso_datetime", r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2})?"),
    ("ymd_slash", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("dmy_or_mdy_slash", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("dmy_or_mdy_short", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("dmy_or_mdy_dash", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("dmy_dot", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d_mon_y", r"^\d{1,2}[- ][A-Za-z]{3,9}[- ]\d{2,4}$"),
    ("mon_d_y", r"^[A-Za-z]{3,9}\.? \d{1,2},? \d{4}$"),
)
# Classes of a text cell, nearest to a type of its own.
CELL_TYPES = (("boolean", r"^(?i)(true|false)$"), ("integer", r"^[+-]?\d+$"), ("float", r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), ("date", r"^\d{4}-\d{1,2}-\d{1,2}"))


def case_variants(df: DataFrame, column: str, max_distinct: int | None = None) -> DataFrame:
    """Labels that differ only in case or white space at the ends: label, n_forms, n_rows, n_padded; with max_distinct, none if the column has more values."""
    c = F.col(column)
    forms = df.where(c.isNotNull()).groupBy(c.alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", folded("raw"))
    groups = forms.groupBy("label").agg(F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_rows"), F.sum(F.when(stripped("raw") != F.col("raw"), F.col("n")).otherwise(0)).alias("n_padded"))
    kept = groups.where((F.col("n_forms") > 1) & ~F.col("label").isin(*MISSING_TOKENS))
    if max_distinct is None:
        return kept
    few = forms.agg((F.count(F.lit(1)) <= max_distinct).alias("few"))  # one row
    return kept.join(F.broadcast(few)).where("few").drop("few")


def numeric_text(df: DataFrame, column: str, min_rate: float = 0.95) -> DataFrame:
    """How many values of a text column are numbers; is_numeric_text from 5 values and min_rate on."""
    out = df.agg(F.count(column).alias("n_values"), F.count(number_of(column)).alias("n_numeric"))
    rate = F.coalesce(F.try_divide("n_numeric", "n_values"), F.lit(0.0))
    return out.select("n_values", "n_numeric", F.round(rate, 6).alias("rate"), ((F.col("n_values") >= 5) & (rate >= min_rate)).alias("is_numeric_text"))


def cell_types(df: DataFrame, column: str) -> DataFrame:
    """Classes of the cells of a text column and their rows; more than one is a mixed column."""
    kind = F.lit("text")
    for name, pattern in reversed(CELL_TYPES):
        kind = F.when(stripped(column).rlike(pattern), name).otherwise(kind)
    return df.where(F.col(column).isNotNull()).groupBy(kind.alias("cell_type")).agg(F.count(F.lit(1)).alias("n"))


def layout_of(column: str) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(DATE_LAYOUTS):
        out = F.when(stripped(column).rlike(pattern), name).otherwise(out)
    return out


def date_layouts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each date layout in a text column, and how many have a first or second part above 12."""
    parts = r"^(\d{1,2})[/-](\d{1,2})[/-]\d{2,4}$"
    first, second = (F.regexp_extract(stripped(column), parts, k).try_cast("int") for k in (1, 2))
    rows = df.where(F.col(column).isNotNull()).select(layout_of(column).alias("layout"), first.alias("a"), second.alias("b"))
    return rows.where("layout IS NOT NULL").groupBy("layout").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > 12).alias("n_first_over_12"), F.count_if(F.col("b") > 12).alias("n_second_over_12"))


def disguised_missing(df: DataFrame, column: str) -> DataFrame:
    """Placeholder texts, with the declared NULLs and the effective share of missing values."""
    hidden = folded(column).isin(*MISSING_TOKENS)
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_declared"), F.count_if(hidden).alias("n_hidden"))
    return out.withColumn("effective_rate", F.round(F.coalesce(F.try_divide(F.col("n_declared") + F.col("n_hidden"), F.col("n_rows")), F.lit(0.0)), 6))


def numeric_sentinels(df: DataFrame, column: str) -> DataFrame:
    """Negative sentinels that repeat in a column whose other values are not negative."""
    x = F.col(column).cast("double")
    is_sentinel = x.isin(*NUMERIC_SENTINELS)
    counts = df.where(is_sentinel).groupBy(x.alias("sentinel")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    rest = df.agg(F.min(F.when(~is_sentinel, x)).alias("rest_min")).where("rest_min >= 0")
    return counts.join(F.broadcast(rest))


def invalid_dates(df: DataFrame, column: str, now: str) -> DataFrame:
    """Sentinel dates, dates outside [1800, now + 100 years], and dates after now; now is an argument, so reruns agree."""
    t = F.col(column).cast("timestamp_ntz")
    at = F.lit(now).cast("timestamp_ntz")
    late = (F.add_months(at.cast("date"), 1200)).cast("timestamp_ntz")
    return df.agg(
        F.count(column).alias("n"), F.count_if(t.isin(*[F.lit(d).cast("timestamp_ntz") for d in DATE_SENTINELS])).alias("n_sentinel"),
        F.count_if((t < F.lit("1800-01-01").cast("timestamp_ntz")) | (t > late)).alias("n_implausible"), F.count_if((t > at) & (t <= late)).alias("n_future"),
    )


def range_pairs(columns: list[str]) -> list[tuple[str, str]]:
    """Pairs of columns whose names differ in the tokens of the ends of a range alone."""
    split = {c: re.split(r"[_\s]+", c.lower()) for c in columns}
    out = []
    for a, at in split.items():
        for b, bt in split.items():
            if a != b and len(at) == len(bt):
                differ = [(x, y) for x, y in zip(at, bt, strict=True) if x != y]
                if len(differ) == 1 and differ[0] in RANGE_TOKENS:
                    out.append((a, b))
    return out


def reversed_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    both = F.col(start).isNotNull() & F.col(end).isNotNull()
    return df.agg(F.count_if(both).alias("n_both"), F.count_if(F.col(end) < F.col(start)).alias("n_reversed"))


def structural_issues(columns: list[str]) -> list[tuple[str, str]]:
    """(column, issue): unnamed headers, and x.1 beside x."""
    names = set(columns)
    out = [(c, "unnamed") for c in columns if not c.strip() or re.match(r"^unnamed:?\s*\d*$", c.strip(), re.I)]
    return out + [(c, "duplicate_header") for c in columns if (m := re.match(r"^(.+)\.\d+$", c)) and m[1] in names]


def aliased_columns(df: DataFrame) -> DataFrame:
    """Pairs of columns of one kind that are equal in every row (NULL equals NULL).

    First a checksum of each column in one aggregate, then exact comparison of the pairs that agree.
    """
    names = df.columns
    schema = "first string, second string, n_rows long"
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    text = {c: F.col(f"`{c}`").cast("string") for c in names}
    sums = df.agg(*[F.coalesce(F.sum(F.pmod(F.xxhash64(F.coalesce(text[c], F.lit("\u0000"))), F.lit(2**31 - 1))), F.lit(0)).alias(f"s{i}") for i, c in enumerate(names)]).first()
    kinds = {f.name: family(f.dataType) for f in df.schema}
    pairs = [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and sums[i] == sums[j] and kinds[a] == kinds[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    checks = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.count(F.lit(1)).alias("n_rows"), F.min(text[a].eqNullSafe(text[b])).alias("same")) for a, b in pairs]
    one = df.agg(*[c.alias(f"p{i}") for i, c in enumerate(checks)])
    return one.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))]))).where("same").drop("same")


def missing_rates(df: DataFrame) -> DataFrame:
    """column, n_missing, rate; and over all of them the complete rows."""
    n = F.count(F.lit(1))
    out = df.agg(n.alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return out.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"), F.round(F.coalesce(F.try_divide(f"m{i}", "n"), F.lit(0.0)), 6).alias("rate")) for i, c in enumerate(df.columns)])))


def co_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of columns missing together: both, either, Jaccard; one aggregate for all pairs."""
    null = {c: F.col(c).isNull() for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = df.agg(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.count_if(null[a] & null[b]).alias("n_both"), F.count_if(null[a] | null[b]).alias("n_either")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = out.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))]))).where("n_either > 0")
    return rows.withColumn("jaccard", F.round(F.col("n_both") / F.col("n_either"), 6))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with one value (NULLs aside)."""
    out = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("string")).eqNullSafe(F.max(F.col(c).cast("string"))).alias("same"), F.count(c).alias("n_values")).alias(f"p{i}") for i, c in enumerate(df.columns)])
    return out.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(df.columns))]))).where("same AND n_values > 0").drop("same")
