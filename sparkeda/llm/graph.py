"""Connected components by joins, with the smallest node of each component as its label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.llm.shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links: (a long, b long), any direction, repeats allowed. Returns (node, label) for all nodes in links.

    Alternating large-star and small-star steps: each hangs the neighbours of a node below the
    smallest one it knows, until every component is a star (rounds grow with the logarithm of the
    longest path). No neighbour list is gathered; a hub is a hot join key, which Spark splits. The
    driver sees a count and a checksum a round. Ends when a round changes nothing, not before.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    before, now = None, ()
    while now != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of u go below its smallest
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "cc")
        discard(edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: smaller neighbours of u, and u, go below the smallest
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "cc")
        discard(large)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = stored(labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct(), "cc-labels")
    discard(edges)
    return out
