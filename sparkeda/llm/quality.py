"""Operator 9: quality rules and robust multivariate outliers (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.llm.shared import SPACE, discard, picked, split_words, stored

#: Fixed point of the statistics, so that sums over a group do not depend on the order of the rows.
UNIT = 10**6
#: Smallest standard deviation of each statistic: most documents have no symbol or repeated line at all.
FLOORS = (0.05, 0.05, 0.10, 0.10)
DIMS = len(FLOORS)
#: Median of the chi-squared distribution with DIMS degrees of freedom.
CHI2_MEDIAN = 3.3566939800333
SHARE = 0.75
MIN_GROUP = 50
#: Squared distance from which a document is rejected: the 0.999 quantile of the same distribution.
#: By FLOORS repeated words reach 50 and repeated lines 100 by themselves, so that each can reject.
CUT = 18.4668269529032
#: Steps of the logarithm of d2 + 1 by which distances are counted: at most a few thousand values.
BINS = 200
#: Least gain in the logarithm of the determinant for which another C-step is made.
GAIN = 1e-9


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Base statistics of whole texts, one row per input row."""
    rows = picked(docs, doc_id, text=text, lang=lang, source=source, **{f"_c{i}": c for i, c in enumerate(carry)})
    kept = [f"_c{i}" for i in range(len(carry))]
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.lit("\u0002")
    worded = rows.select(
        "doc_id", F.concat_ws("\u0001", F.coalesce(F.col("lang").cast("string"), none), F.coalesce(F.col("source").cast("string"), none)).alias("group"), split_words(body, SPACE + "+").alias("words"), body.alias("body"), *kept,
    )
    n = F.size("words")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.slice("words", i, 3)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = worded.select(
        "doc_id", "group", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"), grams.alias("grams"), *kept,
    )
    # hashes with their places, sorted once and only where one comes twice: equal windows are then side by side
    twice = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.when(twice, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))
    counted = counted.select("*", placed.alias("placed"))
    equal = F.transform("placed", lambda x, j: F.when((F.get("placed", j - 1)["g"] == x["g"]) | (F.get("placed", j + 1)["g"] == x["g"]), x["i"]))
    counted = counted.select("*", F.sort_array(F.array_compact(equal)).alias("starts"))
    covered = F.aggregate("starts", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n")), lambda a: a["n"])
    return counted.select(
        "doc_id", "group", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), F.size("lines").alias("n_lines"), *kept,
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector(m: DataFrame) -> DataFrame:
    """Transformed statistics x0.. in fixed point: log of the mean word length, square roots of the shares of symbols, repeated lines and repeated words."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    xs = [F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) + 1), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return m.select("*", *[F.round(x * UNIT).cast("long").alias(f"x{j}") for j, x in enumerate(xs)])


PAIRS = [(j, k) for j in range(DIMS) for k in range(j + 1)]
FIT = [f"m{j}" for j in range(DIMS)] + [f"l{j}{k}" for j, k in PAIRS]


def share_of(value: str, share: float) -> Column:
    """The smallest value with `share` of a group's rows at or below it; state: counts of the value, combined before the shuffle."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


#: Tasks among which a group's rows are dealt where facts about groups reach them by a shuffle.
SALTS = 16


def told(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with facts, one row per key and read from files.

    Spark broadcasts facts below its threshold by their known size. Beyond it both sides are dealt by key and salt,
    so a hot group is many tasks, and what follows still adds up in each task before it shuffles by group.
    """
    many = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(many, [*keys, "_salt"], how).drop("_salt")


def factored(fits: DataFrame, *keys: str) -> DataFrame:
    """(keys, m.., l.., logdet): the Cholesky factor of covariances c.. with the floors added, and the determinant's logarithm."""
    for j, k in PAIRS:
        c = F.col(f"c{j}{k}") + F.lit(FLOORS[j] ** 2 if j == k else 0.0)
        for i in range(k):
            c = c - F.col(f"l{j}{i}") * F.col(f"l{k}{i}")
        fits = fits.withColumn(f"l{j}{k}", F.sqrt(F.greatest(c, F.lit(FLOORS[j] ** 2 / 100))) if j == k else c / F.col(f"l{k}{k}"))
    return fits.select(*keys, *FIT, F.round(sum((2 * F.log(f"l{j}{j}") for j in range(DIMS)), F.lit(0.0)), 12).alias("logdet"))


def starts(good: DataFrame) -> DataFrame:
    """First centres and covariances of each group (g, s): medians, with quartile ranges as scales and a correlation

    of none (s = 0), of spatial signs (1) or of hyperbolic tangents (2) of the scaled statistics. Sums are of
    whole numbers, so they depend neither on the order nor on the partitions of the rows.
    """
    coarse = good.select("g", *[F.floor(F.col(f"x{j}") / (UNIT // 1000)).cast("int").alias(f"q{j}") for j in range(DIMS)])
    marks = coarse.groupBy("g").agg(*[share_of(f"q{j}", p).alias(f"{k}{j}") for j in range(DIMS) for k, p in (("a", 0.25), ("b", 0.5), ("c", 0.75))])
    marks = marks.select("g", *[(F.col(f"b{j}") / 1000).alias(f"m{j}") for j in range(DIMS)], *[F.greatest((F.col(f"c{j}") - F.col(f"a{j}")) / 1000 / 1.349, F.lit(FLOORS[j])).alias(f"s{j}") for j in range(DIMS)])
    marks = stored(marks, "mcd-marks")
    z = told(good, marks, ["g"]).select("g", *[((F.col(f"x{j}") / UNIT - F.col(f"m{j}")) / F.col(f"s{j}")).alias(f"z{j}") for j in range(DIMS)])
    z = z.withColumn("far", F.sqrt(sum((F.col(f"z{j}") * F.col(f"z{j}") for j in range(1, DIMS)), F.col("z0") * F.col("z0"))))
    whole = lambda c: F.round(c * 10**6).cast("long")
    sign = [F.when(F.col("far") > 0, F.col(f"z{j}") / F.col("far")).otherwise(0.0) for j in range(DIMS)]
    bent = [F.tanh(f"z{j}") for j in range(DIMS)]
    sums = z.groupBy("g").agg(*[F.sum(whole(v[j] * v[k])).alias(f"{n}{j}{k}") for n, v in (("u", sign), ("t", bent)) for j, k in PAIRS])
    both = marks.join(sums, "g")
    out = None
    for s, n in enumerate((None, "u", "t")):
        cov = []
        for j, k in PAIRS:
            scale = F.col(f"s{j}") * F.col(f"s{k}")
            alike = F.try_divide(F.col(f"{n}{j}{k}"), F.sqrt(F.col(f"{n}{j}{j}").cast("double") * F.col(f"{n}{k}{k}"))) if n else F.lit(0.0)
            cov.append((scale if j == k else scale * 0.95 * F.coalesce(alike, F.lit(0.0))).alias(f"c{j}{k}"))
        one = factored(both.select("g", F.lit(s).alias("s"), *[f"m{j}" for j in range(DIMS)], *cov), "g", "s")
        out = one if out is None else out.unionByName(one)
    return stored(out, "mcd-starts")


def distanced(rows: DataFrame, fits: DataFrame, *more: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution with the group's Cholesky factor (a row per group, or per group and start)."""
    out = told(rows, fits, ["g"], "left")
    for j in range(DIMS):
        z = F.col(f"x{j}") / UNIT - F.col(f"m{j}")
        for k in range(j):
            z = z - F.col(f"l{j}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{j}", z / F.col(f"l{j}{j}"))
    d2 = sum((F.col(f"z{j}") * F.col(f"z{j}") for j in range(1, DIMS)), F.col("z0") * F.col("z0"))
    return out.select(*rows.columns, *more, d2.alias("d2")).withColumn("bin", F.floor(F.log(F.col("d2") + 1) * BINS).cast("int"))


def concentrate(good: DataFrame, fits: DataFrame, share: float = SHARE) -> DataFrame:
    """One C-step of every (g, s): mean and covariance of the share of the group's rows that are nearest by the fit."""
    far = distanced(good, fits, "s")
    cut = stored(far.groupBy("g", "s").agg(share_of("bin", share).alias("most")), "mcd-cut")
    near = told(far, cut, ["g", "s"]).where("bin <= most")
    exact = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")  # noqa: E731  sums that do not depend on order
    sums = [F.count("*").alias("n")] + [exact(F.col(f"x{j}")).alias(f"s{j}") for j in range(DIMS)] + [exact(F.col(f"x{j}") * F.col(f"x{k}")).alias(f"p{j}{k}") for j, k in PAIRS]
    fit = near.groupBy("g", "s").agg(*sums)
    fit = fit.select("g", "s", "n", *[(F.col(f"s{j}") / F.col("n") / UNIT).alias(f"m{j}") for j in range(DIMS)], *[f"p{j}{k}" for j, k in PAIRS])
    cov = [(F.col(f"p{j}{k}") / F.col("n") / UNIT / UNIT - F.col(f"m{j}") * F.col(f"m{k}")).alias(f"c{j}{k}") for j, k in PAIRS]
    out = stored(factored(fit.select("g", "s", *[f"m{j}" for j in range(DIMS)], *cov), "g", "s"), "mcd-step")
    discard(cut)
    return out


def least(fits: DataFrame) -> DataFrame:
    """Of each group the fit with the least determinant (ties: the first start)."""
    whole = F.struct("s", *FIT, "logdet")
    return fits.groupBy("g").agg(F.min_by(whole, F.struct("logdet", "s")).alias("f")).select("g", "f.*")


def estimate(good: DataFrame) -> DataFrame:
    """Minimum covariance determinant of each group of rows (g, x0..): (g, s, m.., l.., logdet).

    From every start one step to the nearest half, which a cluster of outliers cannot fill, and two
    C-steps; the start with the least determinant goes on, until a step lowers it in no group (the
    driver sees the number of groups in which it did).
    """
    fits = starts(good)
    for share in (0.5, SHARE, SHARE):
        before, fits = fits, concentrate(good, fits, share)
        discard(before)
    before, best = fits, stored(least(fits), "mcd-best")
    discard(before)
    while True:
        step = concentrate(good, best)
        old = best.select("g", F.col("logdet").alias("old"))
        lower = step.join(old, "g").where(F.col("logdet") < F.col("old") - GAIN).drop("old")
        n = lower.count()
        if n:
            before, best = best, stored(least(best.unionByName(lower)), "mcd-best")
            discard(before)
        discard(step)
        if not n:
            return best


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Base rules, and for what passes them a verdict by minimum covariance determinant (MCD).

    Words are [^\\x20\\x09-\\x0D]+ of whole texts (null: none). Base: word_chars (code points in words),
    n_symbols (of #*$%&|<>), n_dup_lines (lines with a word equal to an earlier line), n_repeat_words
    (words in 3-word windows found twice or more, the first included; windows compare by 64-bit hash).
    base_failed: n_words < 50 or 100 * n_repeat_words > 50 * n_words.

    MCD: of each language and source (null is a value of its own), over all rows that pass the base
    rules. C-steps keep the nearest three quarters, from three deterministic starts, and the least
    determinant counts. The distance is scaled by its median, never upwards. Groups under 50 rows are
    fitted together; if those are under 50 as well, they are judged by a fit over all rows that pass the
    base rules. kept is false where base_failed or distance2 >= CUT.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance2 (null if no row passes the base rules) and the columns named in `carry`. One row per input
    row, with null or repeated doc_ids too, equal rows alike; an empty table gives an empty one.
    """
    rows = stored(vector(measured(docs, doc_id, text, lang, source, carry)), "quality-rows")
    sizes = rows.where(~F.col("base_failed")).groupBy("group").agg(F.count("*").alias("size"))
    sizes = stored(sizes, "quality-sizes")
    keyed = told(rows, sizes, ["group"], "left").withColumn("g", F.when(F.coalesce("size", F.lit(0)) >= MIN_GROUP, F.col("group")).otherwise("")).drop("size", "group")
    pool = sizes.where(F.col("size") < MIN_GROUP).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    good = keyed.where(~F.col("base_failed")).select("g", *[f"x{j}" for j in range(DIMS)])
    if pool < MIN_GROUP:
        good = good.where(F.col("g") != "")
        if pool:
            good = good.unionByName(rows.where(~F.col("base_failed")).select(F.lit("").alias("g"), *[f"x{j}" for j in range(DIMS)]))
    best = estimate(good)
    middle = distanced(good, best).groupBy("g").agg(share_of("bin", 0.5).alias("middle"))
    scale = F.greatest(F.lit(1.0), (F.exp((F.col("middle") + 1) / F.lit(float(BINS))) - 1) / CHI2_MEDIAN)
    fits = stored(best.join(middle, "g").withColumn("scale", scale).drop("middle", "s"), "mcd-fits")
    discard(best)
    out = distanced(keyed, fits, "scale").withColumn("distance2", F.round(F.col("d2") / F.col("scale"), 6))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) < CUT)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
