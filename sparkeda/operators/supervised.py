"""Classification and regression readiness."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeda.functions.columns import adjusted_kurtosis, adjusted_skew, edge_bin, equal_bin, finite, hash_order
from sparkeda.functions.ordered import narrowed_quantile, quantiles, running
from sparkeda.operators.associations import contingency


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """Classes (NULL is one), rows, share, and over all of them the normalised entropy and imbalance ratio."""
    c = df.groupBy(F.coalesce(F.col(target).cast("string"), F.lit("<NA>")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    p = c.join(F.broadcast(total)).withColumn("p", F.col("n") / F.col("total"))
    whole = p.agg(F.sum(-F.col("p") * F.log2("p")).alias("h"), F.count(F.lit(1)).alias("k"), (F.max("n") / F.min("n")).alias("ratio"))
    h = F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(0.0)
    return p.join(F.broadcast(whole)).select("label", "n", F.round("p", 6).alias("share"), F.round(h, 6).alias("entropy"), F.round("ratio", 6).alias("imbalance"))


def missing_by_class(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Largest difference between classes of each column's share of NULLs; one aggregate for all columns."""
    by = df.groupBy(target).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"m{i}") for i, c in enumerate(columns)])
    out = by.agg(*[F.struct(F.lit(c).alias("column"), F.round(F.min(f"m{i}"), 6).alias("low"), F.round(F.max(f"m{i}"), 6).alias("high"), ((F.max(f"m{i}") - F.min(f"m{i}")) >= 0.2).alias("differs")).alias(f"s{i}") for i, c in enumerate(columns)])
    return out.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))


def leakage(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Features that give the target away: exact copies, and value rules with .98 accuracy that beat the majority by .05.

    A feature with over max(50, .4 n) values is no rule. `named` tells a name that contains the target's.
    """
    n = df.where(F.col(target).isNotNull()).count()
    base = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).where(F.col(target).isNotNull()).agg(F.max("n").alias("major"))
    out = None
    for f in features:
        cells = contingency(df, f, target)
        best = cells.groupBy("a").agg(F.max("n").alias("best"), F.sum("n").alias("n"), F.min(F.col("a") == F.col("b")).alias("same"))
        one = best.agg(F.lit(f).alias("feature"), F.count(F.lit(1)).alias("n_values"), (F.sum("best") / F.sum("n")).alias("acc"), F.min("same").alias("copy"), F.sum("n").alias("pairs"))
        out = one if out is None else out.unionByName(one)
    lift = F.col("acc") - F.col("major") / F.lit(n)
    rule = (F.col("n_values") <= max(50, 0.4 * n)) & (F.col("acc") >= 0.98) & (lift >= 0.05)
    named = F.lower("feature").contains(target.lower())
    return out.join(F.broadcast(base)).select("feature", "n_values", F.round("acc", 6).alias("accuracy"), (F.col("copy") & (F.col("pairs") == n)).alias("exact_copy"), named.alias("named"), (rule | F.col("copy")).alias("suspect"))


def conflicting_labels(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Equal features with several labels (NULL is a label): groups, rows, labels."""
    label = F.coalesce(F.col(target).cast("string"), F.lit("<NA>"))
    groups = df.groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("k")).where("k > 1")
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("k"), F.lit(0)).alias("max_labels"))


def repeated_entities(df: DataFrame, entity: str) -> DataFrame:
    by = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_of_repeated"))


def by_time_quarter(df: DataFrame, time: str, key: str) -> DataFrame:
    """Rows of the first and the last quarter by time (ties by key): quarter bounds come from two exact quantile cuts of (time, key) counts."""
    t = df.where(F.col(time).isNotNull()).withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    n = t.count()
    q = n // 4
    if q == 0:
        return t.limit(0).withColumn("part", F.lit("early")).drop("_t")
    # counts by time value, cumulated: the cut lies inside one value, whose rows alone are numbered
    c = running(t.groupBy("_t").agg(F.count(F.lit(1)).alias("m")), "_t", "m")
    first = c.where(F.col("cum") >= q).agg(F.min(F.struct("cum", "_t", "m")).alias("s")).first()["s"]
    last = c.where(F.col("cum") > n - q).agg(F.min(F.struct("cum", "_t", "m")).alias("s")).first()["s"]
    edge = t.where(F.col("_t").isin(first["_t"], last["_t"])).withColumn("_r", F.row_number().over(Window.partitionBy("_t").orderBy(key)))
    take_first, take_last = q - (first["cum"] - first["m"]), last["cum"] - (n - q)
    early = t.where(F.col("_t") < first["_t"]).unionByName(edge.where((F.col("_t") == first["_t"]) & (F.col("_r") <= take_first)).drop("_r"))
    late = t.where(F.col("_t") > last["_t"]).unionByName(edge.where((F.col("_t") == last["_t"]) & (F.col("_r") > last["m"] - take_last)).drop("_r"))
    return early.withColumn("part", F.lit("early")).unionByName(late.withColumn("part", F.lit("late"))).drop("_t")


def label_shift(df: DataFrame, target: str, time: str, key: str) -> DataFrame:
    """Share of each label in the first and the last quarter by time."""
    parts = by_time_quarter(df, time, key)
    size = parts.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    share = parts.groupBy("part", F.col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(size), "part")
    return share.groupBy("label").agg(F.round(F.coalesce(F.max(F.when(F.col("part") == "early", F.col("n") / F.col("total"))), F.lit(0.0)), 6).alias("early"), F.round(F.coalesce(F.max(F.when(F.col("part") == "late", F.col("n") / F.col("total"))), F.lit(0.0)), 6).alias("late"))


def fold(key: list[str], folds: int, seed: int = 42) -> Column:
    """Fold of a row by a seeded hash of its key: no sort, the same on any cluster."""
    return F.pmod(hash_order(seed, key), F.lit(folds)).cast("int")


def logistic_probe(df: DataFrame, target: str, features: list[str], key: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """Cross-validated balanced logistic regression: accuracy, balanced accuracy, macro F1, majority baseline, lift. Imputation and scaling are fitted per fold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler

    rows = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("y"), fold([key], folds, seed).alias("fold"), *[finite(f).alias(f"f_{i}") for i, f in enumerate(features)])
    rows = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(rows).transform(rows).persist()
    k = rows.agg(F.count_distinct("label")).first()[0]
    cols = [f"f_{i}" for i in range(len(features))]
    confusion = None
    for i in range(folds):
        train, test = rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)
        counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        train = train.join(F.broadcast(counts), "label").withColumn("w", 1 / F.col("n"))
        pipe = Pipeline(stages=[Imputer(inputCols=cols, outputCols=cols, strategy="median"), VectorAssembler(inputCols=cols, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(weightCol="w", regParam=1e-3, maxIter=50)])
        scored = pipe.fit(train).transform(test).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
        confusion = scored if confusion is None else confusion.unionByName(scored)
    cells = confusion.groupBy("label", "prediction").agg(F.sum("n").alias("n")).collect()
    rows.unpersist()
    m = np.zeros((k, k))
    for c in cells:
        m[int(c["label"]), int(c["prediction"])] = c["n"]
    hit, total = np.diag(m), m.sum()
    recall, precision = hit / np.maximum(m.sum(1), 1), hit / np.maximum(m.sum(0), 1)
    f1 = 2 * precision * recall / np.maximum(precision + recall, 1e-12)
    major = m.sum(1).max() / total
    out = (int(total), float(hit.sum() / total), float(recall.mean()), float(f1.mean()), float(major), float(recall.mean() - 1 / k))
    return df.sparkSession.createDataFrame([out], "n long, accuracy double, balanced_accuracy double, macro_f1 double, majority double, lift double")


def neighbour_disagreement(df: DataFrame, key: str, vector: str, label: str, k: int = 9) -> DataFrame:
    """Share of the k nearest neighbours with another label, of every row among all rows (ties by key); in pairs of blocks."""
    from sparkeda.operators.clustering import nearest

    x = df.where(F.col(label).isNotNull()).select(key, label, F.col(vector).cast("array<double>").alias("v"))
    dims = x.agg(F.max(F.size("v"))).first()[0] or 0
    cols = [f"v{j}" for j in range(dims)]
    near = nearest(x.select(key, *[F.get("v", F.lit(j)).alias(c) for j, c in enumerate(cols)]), key, cols, k)
    own, other = x.select(F.col(key).alias("i"), F.col(label).alias("li")), x.select(F.col(key).alias("j"), F.col(label).alias("lj"))
    both = near.join(own, "i").join(other, "j")
    return both.groupBy(F.col("i").alias(key)).agg(F.round(F.avg((F.col("li") != F.col("lj")).cast("int")), 6).alias("disagreement"))


def target_quantiles(df: DataFrame, target: str) -> DataFrame:
    x = df.select(finite(target).alias("x"))
    n = F.count("x")
    out = x.agg(n.alias("n"), adjusted_skew("x", n).alias("skew"), adjusted_kurtosis("x", n).alias("kurtosis"), F.count_if(F.col("x") == 0).alias("zero"), F.count_if(F.col("x") < 0).alias("negative"), (F.stddev_samp("x") / F.abs(F.avg("x"))).alias("cv"), F.count_distinct("x").alias("d"))
    out = out.join(F.broadcast(quantiles(x, "x", [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]).select("q")))
    tail = (F.col("q")[6] - F.col("q")[3]) / (F.col("q")[3] - F.col("q")[0])
    return out.select("n", *[F.round(F.col("q")[i], 4).alias(p) for i, p in enumerate(("q01", "q05", "q25", "q50", "q75", "q95", "q99"))], F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"), "zero", "negative", F.round("cv", 6).alias("cv"), ((F.col("d") <= 20) | (F.col("d") < 0.05 * F.col("n"))).alias("discrete"), F.round(tail, 6).alias("tail_ratio"))


def yeo_johnson(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_lambda(df: DataFrame, column: str, rounds: int = 4, points: int = 9) -> float:
    """Maximum-likelihood lambda by a shrinking grid: one aggregate a round for all points."""
    x = df.select(finite(column).alias("x")).where("x IS NOT NULL")
    lo, hi = -2.0, 4.0
    for _ in range(rounds):
        grid = np.linspace(lo, hi, points)
        got = x.agg(F.count("x").alias("n"), F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("j"), *[F.var_pop(yeo_johnson(F.col("x"), float(v))).alias(f"v{i}") for i, v in enumerate(grid)]).first()
        like = [-got["n"] / 2 * np.log(max(got[f"v{i}"], 1e-300)) + (v - 1) * got["j"] for i, v in enumerate(grid)]
        best = int(np.argmax(like))
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return float((lo + hi) / 2)


def target_transforms(df: DataFrame, target: str, with_power: bool = False) -> DataFrame:
    """Skewness after log1p and square root (where no value is negative) and after Yeo-Johnson; recommended if |skew| falls by .3 to below .5."""
    x = df.select(finite(target).alias("x"))
    n = F.count("x")
    cells = {"none": F.col("x"), "log1p": F.log1p("x"), "sqrt": F.sqrt("x")}
    if with_power:
        cells["yeo_johnson"] = yeo_johnson(F.col("x"), yeo_johnson_lambda(df, target))
    got = x.agg(F.min("x").alias("lo"), *[adjusted_skew(c, n).alias(f"s_{k}") for k, c in cells.items()])
    usable = {"log1p": F.col("lo") > -1, "sqrt": F.col("lo") >= 0}
    rows = [F.when(usable.get(k, F.lit(True)), F.struct(F.lit(k).alias("transform"), F.round(f"s_{k}", 6).alias("skew"), (F.lit(k != "none") & (F.abs("s_none") - F.abs(f"s_{k}") >= 0.3) & (F.abs(f"s_{k}") < 0.5)).alias("recommended"))) for k in cells]
    return got.select(F.inline(F.array_compact(F.array(*rows))))


def target_spikes(df: DataFrame, target: str, min_rows: int = 5, min_share: float = 0.01, top: int = 5) -> DataFrame:
    """Values with at least min_rows rows and min_share of all, of 50 rows or more, and where they lie."""
    c = df.select(finite(target).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    f = c.agg(F.sum("n").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    where = F.when(F.col("value") == F.col("hi"), "maximum").when(F.col("value") == 0, "zero").when(F.col("value") == F.col("lo"), "minimum").otherwise("interior")
    rows = c.join(F.broadcast(f)).where((F.col("total") >= 50) & (F.col("n") >= min_rows) & (F.col("n") >= min_share * F.col("total")))
    return rows.select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), where.alias("position")).orderBy(F.desc("n"), "value").limit(top)


def target_heaping(df: DataFrame, target: str) -> DataFrame:
    """Share of values that are multiples of 100, 10 and 5; the first with .25 is the heap."""
    x = df.select(finite(target).alias("x")).where("x IS NOT NULL")
    near = lambda b: (F.abs(F.col("x") - F.round(F.col("x") / b) * b) < 1e-8).cast("int")
    got = x.agg(*[F.avg(near(b)).alias(f"r{b}") for b in (100, 10, 5)])
    return got.select(*[F.round(f"r{b}", 6).alias(f"share_{b}") for b in (100, 10, 5)], F.when(F.col("r100") >= 0.25, 100).when(F.col("r10") >= 0.25, 10).when(F.col("r5") >= 0.25, 5).alias("base"))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation of each column and the condition number, from one correlation matrix (k x k numbers reach the driver)."""
    from sparkeda.operators.associations import pearson

    k = len(columns)
    m = np.eye(k)
    for r in pearson(df.dropna(subset=columns), columns).collect():
        i, j = columns.index(r["first"]), columns.index(r["second"])
        m[i, j] = m[j, i] = r["r"]
    inflation, eig = np.diag(np.linalg.pinv(m)), np.linalg.eigvalsh(m)
    cond = float(np.sqrt(eig[-1] / max(eig[0], 1e-12)))
    return df.sparkSession.createDataFrame([(c, round(float(v), 4), round(cond, 4)) for c, v in zip(columns, inflation, strict=True)], "column string, vif double, condition double")


def redundant_pairs(df: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    from sparkeda.operators.associations import pearson

    return pearson(df, columns).where(F.abs("r") >= least)


def linear_fit(df: DataFrame, target: str, features: list[str], penalty: float = 0.0) -> tuple[np.ndarray, dict]:
    """(intercept and coefficients on standardised features, facts): the normal equations from one aggregate."""
    xs = [finite(f) for f in features]
    y = finite(target)
    full = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], y.alias("y")).dropna()
    k = len(features)
    mean = full.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(k)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(k)]).first()
    z = [(F.col(f"x{i}") - mean[f"x{i}"]) / (mean[f"s{i}"] or 1.0) for i in range(k)]
    got = full.agg(*[F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1)], *[F.sum(z[i] * (F.col("y") - mean["y"])).alias(f"q{i}") for i in range(k)]).first()
    a = np.array([[got[f"p{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.solve(a + penalty * np.eye(k), np.array([got[f"q{i}"] for i in range(k)]))
    return np.concatenate([[mean["y"]], beta]), {"n": mean["n"], "mean": [mean[f"x{i}"] for i in range(k)], "std": [mean[f"s{i}"] or 1.0 for i in range(k)], "gram": a}


def predicted(features: list[str], beta: np.ndarray, facts: dict) -> Column:
    out = F.lit(float(beta[0]))
    for f, b, m, s in zip(features, beta[1:], facts["mean"], facts["std"], strict=True):
        out = out + F.lit(float(b)) * (finite(f) - m) / s
    return out


def regression_metrics(scored: DataFrame, actual: str = "y", fitted: str = "p") -> DataFrame:
    e = F.col(actual) - F.col(fitted)
    middle = narrowed_quantile(scored.select(F.abs(e).alias("e")), "e", 0.5)
    got = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.lit(middle).cast("double").alias("medae"), F.sum(e * e).alias("sse"), F.var_pop(actual).alias("v"))
    return got.select("n", F.round(1 - F.col("sse") / (F.col("v") * F.col("n")), 6).alias("r2"), *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "medae")])


def fold_fits(rows: DataFrame, folds: int, k: int, penalty: float) -> list[np.ndarray]:
    """For each fold (intercept, coefficients) of y on x0, x1, ... from the other folds: one aggregate for the means and one for all moments by fold."""
    names = [*[f"x{i}" for i in range(k)], "y"]
    middle = rows.agg(*[F.avg(c).alias(c) for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    if middle["y"] is None:
        return [np.zeros(k + 1) for _ in range(folds)]
    scale = np.array([middle[f"s_{c}"] if middle[f"s_{c}"] > 1e-12 * abs(middle[c]) else 1.0 for c in names])  # of a constant only rounding is left
    z = [(F.col(c) - middle[c]) / s for c, s in zip(names, scale.tolist(), strict=True)]
    pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    cells = rows.groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(z[i]).alias(f"m{i}") for i in range(k + 1)], *[F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    out = []
    for fold in range(folds):
        others = [c for c in cells if c["_fold"] != fold]
        n = sum(c["n"] for c in others)
        if not n:
            raise ValueError("fewer folds with complete rows than a fit needs")
        mean = np.array([sum(c[f"m{i}"] for c in others) for i in range(k + 1)]) / n
        gram = np.zeros((k + 1, k + 1))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = sum(c[f"p{i}_{j}"] for c in others) - n * mean[i] * mean[j]
        std = np.sqrt(np.maximum(np.diag(gram)[:k] / n, 0))
        std[std < 1e-7] = 1.0
        beta = np.linalg.solve(gram[:k, :k] / np.outer(std, std) + penalty * np.eye(k), gram[:k, k] / std) / std * scale[k] / scale[:k]
        at = np.array([middle[c] for c in names]) + mean * scale
        out.append(np.concatenate([[at[k] - beta @ at[:k]], beta]))
    return out


def by_fold(fits: list[np.ndarray]) -> Column:
    """The prediction of the fit that belongs to a row's fold: one scan for all folds."""
    p = [sum((F.lit(float(b)) * F.col(f"x{j}") for j, b in enumerate(beta[1:])), F.lit(float(beta[0]))) for beta in fits]
    return F.coalesce(*[F.when(F.col("_fold") == i, c) for i, c in enumerate(p)])


def ridge_probe(df: DataFrame, target: str, features: list[str], key: str, folds: int = 3, penalty: float = 1.0) -> DataFrame:
    """Cross-validated predictions of ridge regression by normal equations: key, y, p."""
    rows = df.select(key, fold([key], folds).alias("_fold"), finite(target).alias("y"), *[finite(f).alias(f"x{i}") for i, f in enumerate(features)]).dropna(subset=["y", *[f"x{i}" for i in range(len(features))]])
    return rows.select(key, "y", by_fold(fold_fits(rows, folds, len(features), penalty)).alias("p")).dropna(subset=[key])


def fold_blocks(rows: DataFrame, names: list[str]) -> DataFrame:
    """(fold, n, mean, gram, body): some thousand rows of one fold, their columns packed as doubles one after another, with means and the products about them."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            fold, *columns = (c.to_numpy() for c in batch.columns)
            x, held = np.stack(columns), np.unique(fold)
            parts = [x[:, fold == f] for f in held]
            means = [part.mean(1) for part in parts]
            grams = [(d := part - m[:, None]) @ d.T for part, m in zip(parts, means, strict=True)]
            columns = [held, [part.shape[1] for part in parts], means, [g.ravel() for g in grams], [part.tobytes() for part in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()), strict=True)], names=["fold", "n", "mean", "gram", "body"])

    return rows.select("_fold", *names).mapInArrow(run, "fold int, n long, mean array<double>, gram array<double>, body binary")


def summed(blocks: DataFrame, each) -> dict[int, np.ndarray]:
    """The arrays that each(columns of a batch) yields with a number, added up by number."""
    import pyarrow as pa

    def run(batches):
        found = {}
        for batch in batches:
            for i, m in each(*batch.columns):
                found[i] = found.get(i, 0.0) + m.ravel()
        for i, m in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, i, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m)], names=["i", "at", "v"])

    sums = {}
    for r in blocks.mapInArrow(run, "i int, at int, v double").groupBy("i", "at").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r["i"], {})[r["at"]] = r["v"]
    return {i: np.array([v[j] for j in range(len(v))]) for i, v in sums.items()}


def fold_moments(blocks: DataFrame, k: int, middle: np.ndarray) -> dict[int, np.ndarray]:
    """For each fold the moments of (1, x0 - middle, ..., y - middle)."""

    def each(fold, n, mean, gram):
        for f, m, c, g in zip(fold.to_pylist(), n.to_pylist(), mean.to_pylist(), gram.to_pylist(), strict=True):
            d = np.array([1.0, *(np.array(c) - middle)])
            out = m * np.outer(d, d)
            out[1:, 1:] += np.array(g).reshape(k + 1, k + 1)
            yield f, out

    return {i: m.reshape(k + 2, k + 2) for i, m in summed(blocks.select("fold", "n", "mean", "gram"), each).items()}


def huber_sums(blocks: DataFrame, k: int, middle: np.ndarray, scale: np.ndarray, at: dict[int, tuple[np.ndarray, float]]) -> dict[int, np.ndarray]:
    """For each fit (coefficients, cut) in `at`, over the rows of other folds with residual r: the moments of (1, x0, ..., r) where |r| <= cut, and those by weight 1 / |r| elsewhere."""

    def each(folds, bodies):
        for fold, body in zip(folds.to_pylist(), bodies, strict=True):
            z = (np.frombuffer(body.as_buffer()).reshape(k + 1, -1) - middle[:, None]) / scale[:, None]
            b = np.vstack([np.ones(z.shape[1]), z])
            for i, (beta, cut) in at.items():
                if i != fold:
                    b[-1] = z[-1] - beta @ b[:-1]
                    e = np.abs(b[-1])
                    weights = (e <= cut).astype(float), np.divide(1.0, e, out=np.zeros_like(e), where=e > cut)
                    yield i, np.stack([(b * w) @ b.T for w in weights])

    return {i: m.reshape(2, k + 2, k + 2) for i, m in summed(blocks.select("fold", "body"), each).items()}


class HuberFit:
    """Newton's method for n s + sum of s h(r / s) over coefficients and scale s > 0, where h(t) is t^2 up to epsilon and 2 epsilon |t| - epsilon^2 beyond.

    As long as no row passes the cut epsilon s, the least point is known in closed form; each step goes there. Where the rows below the cut leave
    some coefficient open, the rows above it enter by the parabola that touches |r|. A step that makes the sum larger is halved. It starts from least
    squares, by the moments of (1, x0, ..., y) of all rows.
    """

    def __init__(self, moments: np.ndarray, epsilon: float):
        self.epsilon, self.n, self.best, self.done = epsilon, moments[0, 0], np.inf, False
        mean = moments[0, 1:-1] / self.n
        std = np.sqrt(np.maximum(np.diag(moments)[1:-1] / self.n - mean**2, 0))
        std[std < 1e-7] = 1.0
        self.basis = np.diag([1.0, *(1 / std)])
        self.basis[0, 1:] = -mean / std
        gram, v = moments[:-1, :-1], moments[:-1, -1]
        self.full = self.rank(gram)
        self.beta = self.solve(gram, v)
        self.scale = max(np.sqrt(max(moments[-1, -1] - v @ self.beta, 0.0) / self.n), 1e-150)

    def solve(self, gram: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The shortest solution on features with mean 0 and deviation 1 in this fit's rows: a constant one gets 0."""
        return self.basis @ np.linalg.pinv(self.basis.T @ gram @ self.basis, 1e-12, hermitian=True) @ self.basis.T @ v

    def rank(self, gram: np.ndarray) -> int:
        return np.linalg.matrix_rank(self.basis.T @ gram @ self.basis, 1e-12 * self.n, hermitian=True)

    def step(self, inner: np.ndarray, outer: np.ndarray) -> None:
        """Goes on from the moments at beta and the cut."""
        s, e = self.scale, self.epsilon
        free, q = self.n - (self.n - inner[0, 0]) * e * e, inner[-1, -1]
        value = free * s + q / s + 2 * e * outer[-1, -1]
        if value > self.best + 1e-12 * abs(self.best):
            self.move = self.move / 2
        else:
            self.best, self.base = value, np.append(self.beta, s)
            gram, v, pull = inner[:-1, :-1], inner[:-1, -1], outer[:-1, -1]
            if self.rank(gram) == self.full:
                a, b = self.solve(gram, v), e * self.solve(gram, pull)
                rest, free = q - a @ v, free - b @ gram @ b
            else:
                a, b = self.solve(gram + e * s * outer[:-1, :-1], v + e * s * pull), 0.0 * pull
                rest = q - 2 * a @ v + a @ gram @ a
            scale = max(np.sqrt(max(rest, 0.0) / free), 1e-4 * s) if free > 0 else 2 * s  # below, rounding decides
            self.move = np.append(a + scale * b, scale - s)
        self.beta, self.scale = (self.base + self.move)[:-1], max((self.base + self.move)[-1], 1e-150)
        size = np.abs(self.beta).max()
        self.done = np.abs(self.move).max() <= 1e-8 * self.scale + 1e-15 * size or self.scale <= 1e-14 * size  # rounding is near 1e-16 of the size


def huber_fits(rows: DataFrame, folds: int, k: int, epsilon: float = 1.35, rounds: int = 100) -> list[np.ndarray]:
    """For each fold (intercept, coefficients) of the Huber regression of y on x0, x1, ... from the other folds: rows are packed once, then one pass a step for all folds."""
    blocks = fold_blocks(rows, [*[f"x{i}" for i in range(k)], "y"]).persist()
    try:
        total, *sums = blocks.agg(F.sum("n"), *[F.sum(F.col("n") * F.col("mean")[i]) for i in range(k + 1)]).first()
        if not total:
            return [np.zeros(k + 1) for _ in range(folds)]
        middle = np.array(sums) / total
        moments = fold_moments(blocks, k, middle)
        if len(moments) < 2:
            raise ValueError("fewer folds with complete rows than a fit needs")
        scale = np.sqrt(np.diag(sum(moments.values()))[1:] / total)
        scale[scale <= 1e-12 * np.abs(middle)] = 1.0  # of a constant only rounding is left
        unit = np.outer([1.0, *scale], [1.0, *scale])
        fits = [HuberFit(sum(m for f, m in moments.items() if f != i) / unit, epsilon) for i in range(folds)]
        for _ in range(rounds):
            todo = {i: (f.beta, epsilon * f.scale) for i, f in enumerate(fits) if not f.done}
            if not todo:
                break
            for i, (inner, outer) in huber_sums(blocks, k, middle, scale, todo).items():
                fits[i].step(inner, outer)
    finally:
        blocks.unpersist()
    betas = [f.beta[1:] * scale[k] / scale[:k] for f in fits]
    return [np.concatenate([[middle[k] + f.beta[0] * scale[k] - b @ middle[:k]], b]) for f, b in zip(fits, betas, strict=True)]


def huber_probe(df: DataFrame, target: str, features: list[str], key: str, folds: int = 3) -> DataFrame:
    """Cross-validated predictions of Huber regression: key, y, p."""
    names = [f"x{i}" for i in range(len(features))]
    rows = df.select(key, fold([key], folds).alias("_fold"), finite(target).alias("y"), *[finite(f).alias(c) for f, c in zip(features, names, strict=True)]).dropna(subset=[key, "y", *names])
    return rows.select(key, "y", by_fold(huber_fits(rows, folds, len(features))).alias("p"))


def residual_bins(scored: DataFrame, actual: str, fitted: str, bins: int = 10) -> DataFrame:
    """Residuals by quantile bins [a, b) of fitted values (5 rows at least): mean, deviation, mean absolute error."""
    rows = scored.select(finite(actual).alias("y"), finite(fitted).alias("p")).dropna()
    edges = rows.agg(F.array_distinct(F.percentile("p", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))
    e = F.col("y") - F.col("p")
    by = rows.join(F.broadcast(edges)).groupBy(edge_bin(F.col("p"), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.avg(F.abs(e)).alias("mae"))
    return by.where("n >= 5").select("bin", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "mae")])


def residual_shape(scored: DataFrame, actual: str, fitted: str) -> DataFrame:
    """Moments of the residuals and the Breusch-Pagan statistic n corr(e^2, fitted)^2."""
    rows = scored.select((finite(actual) - finite(fitted)).alias("e"), finite(fitted).alias("p")).dropna()
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("std"), F.skewness("e").alias("skew"), F.corr(F.col("e") * F.col("e"), "p").alias("r"))
    return got.select("n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("skew", 6).alias("skew"), F.round(F.col("n") * F.col("r") * F.col("r"), 4).alias("breusch_pagan"))


def subgroup_error(scored: DataFrame, actual: str, fitted: str, group: str) -> DataFrame:
    """Mean absolute error of each level over the target's deviation there, against the median level; levels of 5 % of rows at least."""
    rows = scored.select(F.col(group).cast("string").alias("level"), finite(actual).alias("y"), F.abs(finite(actual) - finite(fitted)).alias("e")).dropna()
    by = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"), F.stddev_samp("y").alias("sd")).withColumn("relative", F.col("mae") / F.col("sd"))
    total = by.agg(F.sum("n").alias("total"))
    kept = by.join(F.broadcast(total)).where(F.col("n") >= 0.05 * F.col("total"))
    middle = kept.agg(F.percentile("relative", 0.5).alias("middle"))
    return kept.join(F.broadcast(middle)).select("level", "n", F.round("mae", 4).alias("mae"), F.round("relative", 6).alias("relative"), F.round(F.col("relative") / F.col("middle"), 6).alias("ratio"))


def cooks_distance(df: DataFrame, target: str, features: list[str], key: str) -> DataFrame:
    """Leverage, standardised error and Cook's distance of every row: the k x k inverse is the only thing solved on the driver."""
    beta, facts = linear_fit(df, target, features)
    k, n = len(features), facts["n"]
    inverse = np.linalg.pinv(facts["gram"])
    z = [(finite(f) - m) / s for f, m, s in zip(features, facts["mean"], facts["std"], strict=True)]
    h = F.lit(1.0 / n)
    for i in range(k):
        for j in range(k):
            h = h + float(inverse[i, j]) * z[i] * z[j]
    rows = df.select(key, (finite(target) - predicted(features, beta, facts)).alias("e"), h.alias("h")).dropna()
    s2 = rows.agg((F.sum(F.col("e") * F.col("e")) / (n - k - 1)).alias("s2"))
    cook = F.col("e") ** 2 * F.col("h") / ((k + 1) * F.col("s2") * (1 - F.col("h")) ** 2)
    return rows.join(F.broadcast(s2)).select(key, F.round("h", 8).alias("leverage"), F.round(F.col("e") / F.sqrt("s2"), 6).alias("error"), F.round(cook, 8).alias("cook"))


def weak_support(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal bins of a column with under 2 % of rows though 5 % lie on either side."""
    x = df.select(finite(column).alias("x")).where("x IS NOT NULL")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total"))
    c = x.join(F.broadcast(ends)).groupBy(equal_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(c, "bin", "left").na.fill(0, ["n"]).join(F.broadcast(ends.select("total")))
    w = Window.orderBy("bin")  # over the bins, not the rows
    sides = grid.select("*", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    thin = (F.col("n") < 0.02 * F.col("total")) & (F.coalesce("below", F.lit(0)) >= 0.05 * F.col("total")) & (F.coalesce("above", F.lit(0)) >= 0.05 * F.col("total"))
    return sides.select("bin", "n", thin.alias("thin"))


def shares_target_name(target: str, feature: str) -> bool:
    """A common name token of three letters or more; never a mere substring."""
    split = lambda s: {t for t in re.split(r"[^a-z0-9]+", s.lower()) if len(t) >= 3}
    return bool(split(target) & split(feature))
