"""Ordered analytics over many values without one task that sees them all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(values: DataFrame, order: str, n: str | None = None) -> DataFrame:
    """values with `next` (the following value of `order`) and, with n, `cum` (sum of n up to and with the row).

    `order` is numeric and distinct. The values are dealt into ranges by approximate quantiles; each
    range has its own window, and what crosses a border comes from one row per range.
    """
    parts = min(1024, max(16, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = values.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 1000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda e: e < F.col(order))) if cuts else F.lit(0)
    dealt = values.withColumn("_part", part)
    count = F.col(n) if n else F.lit(0)
    each = dealt.groupBy("_part").agg(F.min(order).alias("_low"), F.sum(count).alias("_sum"))
    o = Window.orderBy("_part")  # over the ranges
    each = each.select("_part", (F.sum("_sum").over(o) - F.col("_sum")).alias("_before"), F.lead("_low").over(o).alias("_following"))
    w = Window.partitionBy("_part").orderBy(order)
    out = dealt.join(F.broadcast(each), "_part").withColumn("next", F.coalesce(F.lead(order).over(w), F.col("_following")))
    if n:
        out = out.withColumn("cum", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"))
    return out.drop("_part", "_before", "_following")


def backward_steps(rows: DataFrame, order: str, value: str, width: int = 1_000_000) -> DataFrame:
    """n_backward: rows whose value is below that of the row before, by an integer key: windows within spans of the key, and the borders between spans."""
    span = F.floor(F.col(order) / width)
    r = rows.select(span.alias("_s"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    w = Window.partitionBy("_s").orderBy("_o", "_v")
    inside = r.select((F.col("_v") < F.lag("_v").over(w)).alias("b")).agg(F.count_if("b").alias("n"))
    ends = r.groupBy("_s").agg(F.min_by("_v", F.struct("_o", "_v")).alias("first"), F.max_by("_v", F.struct("_o", "_v")).alias("last"))
    edge = ends.select((F.col("first") < F.lag("last").over(Window.orderBy("_s"))).alias("b")).agg(F.count_if("b").alias("m"))
    return inside.join(F.broadcast(edge)).select((F.col("n") + F.col("m")).alias("n_backward"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, x, n): how often each finite value of column number i occurs; one scan and one shuffle for all columns."""
    from sparkeda.functions.columns import finite

    cells = F.array(*[F.struct(F.lit(i).alias("i"), finite(F.col(f"`{c}`")).alias("x")) for i, c in enumerate(columns)])
    return df.select(F.inline(cells)).where("x IS NOT NULL").groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))


def quantile_table(counts: DataFrame, shares: list[float], parts: int = 64) -> dict[int, list[float | None]]:
    """Exact quantiles with linear interpolation of each column in value_counts(), by column number.

    Approximate quantiles cut each column into ranges. The driver sees the rows of each range (parts for each
    column), so it knows in which ranges the wanted places lie; the values of these alone are put in order.
    """
    counts = counts.persist()
    cuts = {r["i"]: sorted(set(r["c"])) for r in counts.groupBy("i").agg(F.percentile_approx("x", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 1000).alias("c")).collect()}
    if not cuts:
        counts.unpersist()
        return {}
    part = None
    for i, c in cuts.items():
        found = F.size(F.filter(F.array(*[F.lit(float(v)) for v in c]), lambda e: e < F.col("x")))
        part = F.when(F.col("i") == i, found) if part is None else part.when(F.col("i") == i, found)
    dealt = counts.withColumn("p", part)
    places: dict[int, dict[int, tuple[int, int]]] = {}  # column -> place in the order -> (range, rows before the range)
    totals: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(dealt.groupBy("i", "p").agg(F.sum("n").alias("s")).collect()):
        totals.setdefault(r["i"], []).append((r["p"], r["s"]))
    for i, ranges in totals.items():
        n, before = sum(s for _, s in ranges), 0
        wanted = {int(f((n - 1) * p)) for p in shares for f in (math.floor, math.ceil)}
        places[i] = {}
        for p, s in ranges:
            places[i] |= {w: (p, before) for w in wanted if before <= w < before + s}
            before += s
    keys = sorted({(i, p) for i, at in places.items() for p, _ in at.values()})
    kept = dealt.where(F.struct("i", "p").isin([F.struct(F.lit(i), F.lit(p)) for i, p in keys]))
    cum = kept.withColumn("cum", F.sum("n").over(Window.partitionBy("i", "p").orderBy("x")))
    spots = [(i, w, p, before) for i, at in places.items() for w, (p, before) in at.items()]
    got = cum.agg(*[F.min(F.when((F.col("i") == i) & (F.col("p") == p) & (F.col("cum") > w - before), F.col("x"))).alias(f"v{k}") for k, (i, w, p, before) in enumerate(spots)]).first()
    counts.unpersist()
    value = {(i, w): got[f"v{k}"] for k, (i, w, _, _) in enumerate(spots)}
    out = {}
    for i, ranges in totals.items():
        n = sum(s for _, s in ranges)
        ends = [((n - 1) * p, value[i, math.floor((n - 1) * p)], value[i, math.ceil((n - 1) * p)]) for p in shares]
        out[i] = [a + (b - a) * (at - math.floor(at)) for at, a, b in ends]
    return out


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> list[list[float | None]]:
    """Exact quantiles of several columns' finite values, in their order; None where a column has none."""
    found = quantile_table(value_counts(df, columns), shares)
    return [found.get(i, [None] * len(shares)) for i in range(len(columns))]


def quantiles(df: DataFrame, column: str, shares: list[float], round_to: int | None = None) -> DataFrame:
    """One row (n, q): exact quantiles with linear interpolation of finite values, from cumulated counts of distinct values.

    percentile() in an aggregate keeps every distinct value of a column in one task; this deals them out.
    """
    from sparkeda.functions.columns import finite

    c = df.select(finite(column).alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    cum = running(c, "x", "m")
    n = c.agg(F.sum("m").alias("n"))
    ends = []
    for i, p in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(float(p))
        ends += [F.min(F.when(F.col("cum") > F.floor(at), F.col("x"))).alias(f"a{i}"), F.min(F.when(F.col("cum") > F.ceil(at), F.col("x"))).alias(f"b{i}")]
    got = cum.join(F.broadcast(n)).agg(F.first("n").alias("n"), *ends)
    q = []
    for i, p in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(float(p))
        v = F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (at - F.floor(at))
        q.append(v if round_to is None else F.round(v, round_to))
    return got.select("n", F.array(*q).alias("q"))


def narrowed_quantile(df: DataFrame, column: str, share: float, accuracy: int = 10_000) -> float | None:
    """An exact quantile with linear interpolation of a column's finite values; None without any.

    Two approximate quantiles bracket the place. Values outside count as one below and one above, so of n rows some 4 n / accuracy are put in
    order. The counts show whether the bracket holds the place; if not, it widens.
    """
    # each expression names x once: Spark would work a long one out anew for every mention
    x = df.select(F.col(column).cast("double").alias("x")).where(F.abs("x") < float("inf"))
    wide = 2.0 / accuracy
    while True:
        cuts = x.agg(F.percentile_approx("x", F.array(F.lit(max(0.0, share - wide)), F.lit(min(1.0, share + wide))), accuracy).alias("c")).first()["c"]
        if cuts is None:
            return None
        low, high = math.nextafter(cuts[0], -math.inf), math.nextafter(cuts[1], math.inf)
        place = F.greatest(F.least(F.col("x"), F.lit(high)), F.lit(low))
        c = x.select(place.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("m"))
        cum = c.select("x", F.sum("m").over(Window.orderBy("x")).alias("cum"), F.sum("m").over(Window.partitionBy()).alias("n"))
        at = (F.col("n") - 1) * F.lit(float(share))
        got = cum.agg(F.min(F.when(F.col("cum") > F.floor(at), F.col("x"))).alias("a"), F.min(F.when(F.col("cum") > F.ceil(at), F.col("x"))).alias("b"), F.first(at - F.floor(at)).alias("part")).first()
        if low < got["a"] and got["b"] < high:
            return got["a"] + (got["b"] - got["a"]) * got["part"]
        wide *= 8


def row_index(df: DataFrame, name: str) -> DataFrame:
    """df with the number of each row, from 0 in the order of its partitions, frozen: later plans see the same numbers.

    Kept by a checkpoint where the session has a folder for one, else (local runs) by persisting.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    marked = marked.checkpoint() if spark.sparkContext.getCheckpointDir() else marked.persist()
    # within a partition this id counts from the first row; the partition's number stands above bit 33
    sizes = marked.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    both = marked.join(F.broadcast(sizes), F.shiftright("_m", 33) == F.col("_p"))
    return both.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_before")
