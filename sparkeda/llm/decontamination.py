"""Operator 6: benchmark decontamination by winnowing (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.llm.shared import ascii_lower, discard, keyed_texts, picked, real_id, split_words, stored

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark windows that one broadcast holds: about 10 MB. A larger benchmark goes in blocks of it.
BLOCK_WINDOWS = 100_000


def words_of(c: Column) -> Column:
    return split_words(ascii_lower(c), GAPS)


def gram_hashes(words: str, k: int) -> Column:
    n = F.size(words) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def window_minima(hashes: str, width: int) -> Column:
    """The smallest hash of each run of `width` hashes; none for shorter lists."""
    n = F.size(hashes) - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.array_min(F.slice(hashes, i, width)))).otherwise(F.array().cast("array<bigint>"))


def window_key(w: Column) -> list[Column]:
    """Two hashes of a window's words, 96 bits."""
    return [F.xxhash64(w).alias("a"), F.hash(w).alias("b")]


def benchmark_windows(benchmark: DataFrame, size: int, k: int, item_id: str, text: str) -> DataFrame:
    """One row per distinct window of an item: item_id, fp (fingerprint), m (words), a and b (its key).

    The fingerprint of a full window is the smallest hash of its k-grams; of a shorter item, which is
    one window, it is the hash of its longest word.
    """
    items = picked(benchmark, item=item_id, text=text).where("item IS NOT NULL")
    items = items.select(F.col("item").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    long = items.where(F.size("words") >= size).select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("w"))
    long = long.withColumn("fp", F.array_min(gram_hashes("w", k)))
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = items.where(F.size("words") < size).select("item_id", F.col("words").alias("w"), F.xxhash64(F.array(longest)).alias("fp"))
    return long.unionByName(short).select("item_id", "fp", F.size("w").alias("m"), *window_key(F.col("w"))).distinct()


def scanned(worded: DataFrame, keys: list[str], prints: DataFrame, short: bool, size: int, k: int) -> DataFrame:
    """(keys, n_words, met): a row for each document, and one for each of its fingerprints that the benchmark has.

    Only fingerprints leave the text's row, never its words beside each, so work is linear in the length.
    """
    entries = F.array_distinct(window_minima("h", size - k + 1))
    entries = F.transform(entries, lambda x: F.struct(x.alias("fp"), F.lit(False).alias("short")))
    if short:
        own = F.array_distinct(F.transform("words", lambda w: F.xxhash64(F.array(w))))
        entries = F.concat(entries, F.transform(own, lambda x: F.struct(x.alias("fp"), F.lit(True).alias("short"))))
    entries = F.array_append(entries, F.struct(F.lit(None).cast("bigint").alias("fp"), F.lit(False).alias("short")))
    # exploded where it is made: of a named column Spark would infer a filter and push it, lambdas and all, below the hashes
    grams = worded.withColumn("h", gram_hashes("words", k)).select(*keys, F.size("words").cast("long").alias("n_words"), F.explode(entries).alias("e"))
    each = grams.select(*keys, "n_words", "e.fp", "e.short")
    met = each.join(F.broadcast(prints.withColumn("met", F.lit(True))), ["fp", "short"], "left")
    return met.where(F.col("met") | F.col("fp").isNull()).select(*keys, "n_words", F.coalesce("met", F.lit(False)).alias("met"))


def extended(worded: DataFrame, keys: list[str], windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(keys, item_id, at, n): hits of documents with a known fingerprint, extended to whole windows of n words at word `at`."""
    def spots(m: int) -> Column:
        keyed = F.transform(F.sequence(F.lit(0), F.size("words") - m), lambda i: F.struct(i.alias("at"), F.lit(m).alias("m"), *window_key(F.slice("words", i + 1, m))))
        return F.when(F.size("words") >= m, keyed).otherwise(F.array().cast("array<struct<at:int,m:int,a:bigint,b:int>>"))

    each = worded.select(*keys, F.explode(F.concat(*[spots(m) for m in lengths])).alias("s")).select(*keys, "s.*")
    return each.join(F.broadcast(windows.select("item_id", "m", "a", "b").distinct()), ["m", "a", "b"]).select(*keys, "item_id", "at", F.col("m").alias("n"))


def summarise(scan: DataFrame, real: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document; words under several windows count once."""
    docs = scan.groupBy(*keys).agg(F.max("n_words").alias("n_words"))
    spots = real.select(*keys, F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct().groupBy(*keys).agg(F.count("*").alias("n_hit"))
    items = real.select(*keys, "item_id").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    joined = docs.join(spots, keys, "left").join(items, keys, "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        real_id(), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *keys[1:],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, k: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Words of whole documents inside any occurrence of a window of `size` words of a benchmark item.

    Winnowing: of every run of size - k + 1 k-gram hashes the smallest is a fingerprint, so each
    shared span of `size` words shares one. Documents with a fingerprint of the benchmark are read
    again, and hits are extended to whole windows, compared by two hashes (96 bits). An item
    with fewer words (but not none) is one window. A-Z are lower-cased, words are
    [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; null has none. Work is linear in the length of a text. A
    benchmark of more than BLOCK_WINDOWS windows goes in blocks, so a broadcast is of bounded size.

    Returns doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted item_ids, comma-joined),
    contaminated and the columns named in `carry`, which with doc_id tell documents apart (they hold
    no nulls). Rows that repeat these give one row (a word position hit in any of them counts,
    n_words is the largest); null doc_ids are one document, null item_ids no item. Empty tables
    give no rows, an empty benchmark no hits.
    """
    keys = ["doc_id", *carry]
    rows = keyed_texts(docs, doc_id, text, carry)
    worded = lambda df: df.select(*keys, words_of(F.col("text")).alias("words"))
    windows = stored(benchmark_windows(benchmark, size, k, item_id, item_text), "decon-windows")
    n = windows.count()
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most `size` of them
    blocks, scan, real = max(1, -(-n // BLOCK_WINDOWS)), None, None
    for b in range(blocks):
        side = windows if blocks == 1 else windows.where(F.pmod("fp", F.lit(blocks)) == b)
        prints = side.select("fp", (F.col("m") < size).alias("short")).distinct()
        found = stored(scanned(worded(rows), keys, prints, min(lengths, default=size) < size, size, k), "decon-scan")
        mine = stored(found.where("met").select(*keys).distinct(), "decon-candidates")
        hits = extended(worded(rows.join(mine, keys, "left_semi")), keys, side, lengths) if lengths else mine.select(*keys, F.lit("").alias("item_id"), F.lit(0).alias("at"), F.lit(0).alias("n")).limit(0)
        hits = stored(hits, "decon-hits")
        discard(mine)
        scan, real = (found, hits) if scan is None else (scan, real.unionByName(hits))
    return summarise(scan, real, keys)


def oracle(size: int = 10) -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, {words} AS w FROM benchmark),
l AS (SELECT item_id, w, least(len(w), {size}) AS n FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, w[i + 1 : i + n] AS w, n FROM (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM l)),
d AS (SELECT doc_id, {words} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
m AS (SELECT n FROM v GROUP BY n),
g AS (SELECT doc_id, i, m.n, w[i + 1 : i + m.n] AS w FROM p, m WHERE i + m.n <= len(w)),
h AS (SELECT DISTINCT g.doc_id, v.item_id, g.i, g.n FROM g JOIN v ON g.n = v.n AND g.w = v.w),
s AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)"""
