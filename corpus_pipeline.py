"""A corpus in five stages; each works on all that the one before it kept.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents, with others that docs may have. Rows are told apart by doc_id and text: rows that
repeat a doc_id (after mixing, say) with another text get verdicts of their own. Null doc_ids and
texts are values like others, an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkeda.llm import decontamination, jaccard, mixing, quality, sharding
from sparkeda.llm.shared import NO_ID, numbered, place_of, stored

HASH = "text_hash"


def _named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns by number, and the numbers of doc_id, text, lang and source."""
    return numbered(docs), {name: f"_{place_of(docs, name)}" for name in ("doc_id", "text", "lang", "source")}


def _told_apart(docs: DataFrame, at: dict[str, str]) -> DataFrame:
    """docs with a hash of the text, which is the same in every row with that text."""
    return docs.withColumn(HASH, F.xxhash64(F.col(at["text"])))


def _key(at: dict[str, str]):
    """(doc_id, hash) of a row, without nulls."""
    return F.coalesce(F.col(at["doc_id"]), F.lit(NO_ID)), F.col(HASH)


def _side(keys: DataFrame, *more: str) -> DataFrame:
    """Keys (doc_id, hash) under names of their own, to join rows with: texts are dealt by the key, neither sorted nor broadcast."""
    return keys.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_of"), F.col(HASH).alias("_of_hash"), *more).hint("shuffle_hash")


def _without(rows: DataFrame, at: dict[str, str], gone: DataFrame) -> DataFrame:
    """Rows whose (doc_id, hash) is not among gone."""
    of, of_hash = _key(at)
    return rows.join(_side(gone), (of == F.col("_of")) & (of_hash == F.col("_of_hash")), "left_anti")


def _among(rows: DataFrame, at: dict[str, str], keys: DataFrame, *more: str) -> DataFrame:
    """Rows whose (doc_id, hash) is in keys, with the columns `more` of keys."""
    of, of_hash = _key(at)
    return rows.join(_side(keys, *more), (of == F.col("_of")) & (of_hash == F.col("_of_hash"))).drop("_of", "_of_hash")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    rows, at = _named(docs)
    rows = _told_apart(rows, at)
    found = quality.judge(rows, at["doc_id"], at["text"], at["lang"], at["source"], (HASH, at["lang"], at["source"]))
    # rows alike in id and text may differ in language or source, and so in their verdict: these count as well
    labels = [F.coalesce(F.col(at[c]).cast("string"), F.lit("")) for c in ("lang", "source")]
    gone = found.where(~F.col("kept")).select("doc_id", F.xxhash64(HASH, *labels).alias(HASH)).distinct()
    left = _without(rows.withColumn(HASH, F.xxhash64(HASH, *labels)), at, gone)
    return left.drop(HASH).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays: the smallest doc_id, and of its texts the one with the smallest hash."""
    rows, at = _named(docs)
    rows = _told_apart(rows, at)
    found = stored(jaccard.cluster(rows, doc_id=at["doc_id"], text=at["text"], carry=(HASH,)).where("n_shingles > 0"), "pipeline-groups")
    own = "component_id <=> doc_id"
    # rows under the smallest doc_id of their component: one, unless rows repeat it
    key = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col(HASH).alias("h"))
    heads = found.where(own).groupBy("group_id", "doc_id", HASH).agg(F.count("*").alias("n")).withColumn("key", key)
    first = heads.groupBy("group_id").agg(F.min("key").alias("first"))
    heads = stored(heads.join(first, "group_id").select("doc_id", HASH, "n", (F.col("key") == F.col("first")).alias("is_first")), "pipeline-heads")
    gone = found.where(f"NOT ({own})").select("doc_id", HASH).unionByName(heads.where("NOT is_first").select("doc_id", HASH)).distinct()
    again = stored(heads.where("is_first AND n > 1").select("doc_id", HASH), "pipeline-again")
    if again.isEmpty():
        return _without(rows, at, gone).drop(HASH).toDF(*docs.columns)
    # rows alike in id and text: the least of them by all columns
    single = _without(rows, at, gone.unionByName(again))
    one = _among(rows, at, again).groupBy(at["doc_id"], HASH).agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
    return single.unionByName(one).drop(HASH).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go."""
    rows, at = _named(docs)
    rows = _told_apart(rows, at)
    found = decontamination.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=at["doc_id"], text=at["text"], carry=(HASH,))
    gone = found.where("contaminated").select("doc_id", HASH)
    return _without(rows, at, gone).drop(HASH).toDF(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; the last repetition counts if at least half its words are taken."""
    rows, at = _named(docs)
    rows = _told_apart(rows, at)
    mixed = mixing.mix(rows, doc_id=at["doc_id"], text=at["text"], source=at["source"], carry=(HASH,)).where("size > 0")
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    mixed = stored(mixed.groupBy("doc_id", HASH).agg(F.sum(times).alias("_times"), F.count("*").alias("_rows")).where("_times > 0"), "pipeline-times")
    out = _among(rows, at, mixed.where("_rows = 1"), "_times")
    if not mixed.where("_rows > 1").isEmpty():
        # rows alike in id and text share their repetitions, as evenly as whole numbers go
        alike = Window.partitionBy(at["doc_id"], HASH).orderBy(F.xxhash64(*[c for c in rows.columns if c != HASH]))
        many = _among(rows, at, mixed.where("_rows > 1"), "_times", "_rows").withColumn("_n", F.row_number().over(alike))
        share = F.floor(F.col("_times") / F.col("_rows")) + F.when(F.col("_n") <= F.col("_times") % F.col("_rows"), 1).otherwise(0)
        out = out.unionByName(many.withColumn("_times", share.cast("long")).where("_times > 0").select(*out.columns))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select(*[c for c in rows.columns if c != HASH]).toDF(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with slot and shard."""
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mix),
    ("sharding", shards),
]

#: The outlier fit, the components and the seeded mix are beyond one SQL statement; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
