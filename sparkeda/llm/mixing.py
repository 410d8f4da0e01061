"""Operator 5: mixing sources to target weights by capped water-filling (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeda.llm.shared import WORD, discard, picked, ranked, stored

#: Rows of a bucket, about.
PER_BUCKET = 4096


def source_sizes(sized: DataFrame) -> DataFrame:
    """One row per source: source, n_docs, source_size, weight rank (by code point, null last)."""
    by = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    return ranked(by, "rank", F.col("source").asc_nulls_last())  # strings compare by UTF-8 bytes, which is by code point


def water_fill(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Add target: shares by weight of the sum of all sizes, clamped at max_epochs times the source's size.

    Each round clamps the sources above their limit and raises the level (words per unit of weight)
    for the others; the driver sees three sums a round. The level only rises, so what is clamped stays.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * max_epochs)
    total, level = None, 0.0
    clamped_before = -1
    while True:
        is_clamped = F.col("weight") * F.lit(level) > F.col("limit")
        got = filled.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(is_clamped, F.col("limit"))).alias("limit"), F.sum(F.when(~is_clamped, F.col("weight"))).alias("weight"), F.count(F.when(is_clamped, 1)).alias("n")
        ).first()
        total = got["total"] or 0
        if got["n"] == clamped_before or not got["weight"]:
            break
        clamped_before = got["n"]
        level = (total - (got["limit"] or 0)) / got["weight"]
    return filled.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), F.col("limit").cast("double")))


def prefix_digits(n: Column, per_bucket: int = PER_BUCKET) -> Column:
    """Hexadecimal digits of the key that deal a source of n rows into buckets of about per_bucket rows."""
    digits = F.lit(0)
    for k in range(1, 13):
        digits = F.when(n > per_bucket * 16 ** (k - 1), k).otherwise(digits)
    return digits


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1", doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of every document.

    Size: number of [^\\x20\\x09-\\x0D]+ in the whole text (null: 0). A source's target over its size
    is its number of repetitions: every document is taken whole so many times (the whole part). For
    the fraction, each bucket of a source (dealt by a seeded md5 of the doc_id, so a source with a
    third of all rows is many buckets) takes its documents once more in the order of that md5 until
    the bucket's quota of words is full; the last one is taken in part. So taken words miss a target
    by less than one word a bucket, no document exceeds max_epochs times its size, and reruns agree.

    Returns doc_id, size, source_size, target (its source's), taken and the columns named in `carry`.
    Documents without words take none. Rows that repeat a doc_id count as documents of their own; null
    doc_ids share the key ''. Rows of a doc_id (or null) that has more than a bucket's rows are keyed
    one by one, by the place at which their sizes were stored, so that they fill many buckets. An
    empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = picked(docs, doc_id, text=text, source=source, **{c: c for c in carry})
    sized = stored(rows.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("_row"), *carry), "mix-sizes")
    by_source = stored(source_sizes(sized), "mix-sources")
    sources = stored(water_fill(by_source, weights, max_epochs), "mix-targets")
    discard(by_source)
    # repeated more often than a bucket has rows: none in most tables, never more than one in PER_BUCKET rows
    often = stored(sized.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > PER_BUCKET).select(F.col("doc_id").alias("_id"), F.lit(True).alias("_often")), "mix-often")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    if often.isEmpty():
        keyed = sized.withColumn("key", F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")))
    else:
        keyed = sized.join(often, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        name = F.when(F.col("_often"), F.concat(name, F.lit(":"), F.col("_row").cast("string"))).otherwise(name)
        keyed = keyed.withColumn("key", F.md5(F.concat(F.lit(seed + ":"), name).cast("binary"))).drop("_id", "_often")
    # a small table read back from files: its size is known, and Spark broadcasts it only below its threshold
    placed = keyed.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("bucket", F.substring("key", F.lit(1), prefix_digits(F.col("n_docs"))))
    bucket = Window.partitionBy("source", "bucket")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(rate), F.lit(max_epochs))
    before = F.sum("size").over(bucket.orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    quota = F.round((rate - whole) * F.sum("size").over(bucket)).cast("long")
    part = F.greatest(F.least(F.col("size"), F.col("quota") - F.col("before")), F.lit(0))
    out = placed.select("*", whole.alias("whole"), before.alias("before"), quota.alias("quota"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), *carry)


def oracle(weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1") -> str:
    """Water-filling in closed form: with sources by limit over weight, the level at the first that is not clamped."""
    digits = " ".join(f"WHEN n_docs > {4096 * 16 ** (k - 1)} THEN {k}" for k in range(12, 0, -1))
    return rf"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM z GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, weights))}][rank % {len(weights)} + 1] AS weight, source_size * {max_epochs} AS lim FROM s),
o AS (SELECT *, sum(lim) OVER q - lim AS below, sum(weight) OVER () - sum(weight) OVER q + weight AS left_weight, sum(source_size) OVER () AS total FROM w
  WINDOW q AS (ORDER BY lim / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
v AS (SELECT coalesce(max((total - below)::DOUBLE / left_weight) FILTER (true), 0) AS level FROM o),
t AS (SELECT source, n_docs, source_size, least(weight * level, lim::DOUBLE) AS target FROM w, v),
k AS (SELECT z.doc_id, z.size, t.*, md5('{seed}:' || coalesce(z.doc_id::VARCHAR, '')) AS key, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, substr(key, 1, CASE {digits} ELSE 0 END) AS bucket, least(floor(rate), {max_epochs})::BIGINT AS whole FROM k),
p AS (SELECT *, sum(size) OVER (PARTITION BY source, bucket ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before, round((rate - whole) * sum(size) OVER (PARTITION BY source, bucket))::BIGINT AS quota FROM b)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (whole * size + greatest(least(size, quota - before), 0))::BIGINT AS taken FROM p"""
