"""What the operators share: tables that outlive an executor, column picking, joins on hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside operators; it sorts before all others. A doc_id of this value counts as null.
NO_ID = -(2**63)
#: Rows of one key that one task of a join takes; more are dealt out.
PER_SALT = 2048


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a folder of its own in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkeda-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session is gone; nothing depends on this
        pass


_ROOTS: set[str] = set()


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the session's own part of the shared folder, which goes when the program ends."""
    root = f"{shared_dir(spark)}/sparkeda-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and any executor can read it again."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for t in tables:
        if t is not None:
            _delete(t.sparkSession, t.stored_at)


def place_of(docs: DataFrame, name: str) -> int:
    """Place of a column: of this very name, else the only one that equals it without regard to case."""
    exact = [i for i, c in enumerate(docs.columns) if c == name]
    found = exact or [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}: {docs.columns}")
    return found[0]


def numbered(docs: DataFrame) -> DataFrame:
    """The same rows with columns _0, _1 ..: names that clash, also in case alone, can then do no harm."""
    return docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])


def picked(docs: DataFrame, doc_id: str | None = None, **wanted: str) -> DataFrame:
    """Columns by new names, doc_id as long; an integer type is asked of it, as results are ordered by it."""
    out = []
    if doc_id is not None:
        at = place_of(docs, doc_id)
        if not isinstance(docs.schema[at].dataType, (T.IntegralType, T.NullType)):
            raise TypeError(f"{doc_id} is no integer column: {docs.schema[at].dataType.simpleString()}")
        out.append(F.col(f"_{at}").cast("long").alias("doc_id"))
    out += [F.col(f"_{place_of(docs, c)}").alias(name) for name, c in wanted.items()]
    return numbered(docs).select(*out)


def keyed_texts(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, carried columns) with nulls replaced: NO_ID and the empty text."""
    rows = picked(docs, doc_id, text=text, **{c: c for c in carry})
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)


def real_id(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; lower() does the same where a text is ASCII, and quicker."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def split_words(c: Column, gaps: str) -> Column:
    """The parts of a text between runs of the characters in gaps (a regular expression); null: none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), gaps), "")


def hot_keys(counts: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """(keys, salts) of the keys in counts (keys, n) that stand for a thousandth of all rows, and for PER_SALT at least.

    There are at most a thousand such keys, so this table may be broadcast whatever the input.
    """
    least = max(PER_SALT, rows // 1000)
    return counts.where(F.col("n") >= least).select(*keys, F.ceil(F.col("n") / F.lit(least)).cast("int").alias("salts"))


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """rows with `salt`: 0, or for a hot key one of its salts by the hash `by`."""
    return rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.coalesce(F.pmod(by, F.col("salts")).cast("int"), F.lit(0))).drop("salts")


def repeated_salts(facts: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """facts (one row per key) once for each salt of the key."""
    many = facts.join(F.broadcast(hot), keys, "left")
    return many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def ranked(df: DataFrame, name: str, order: Column) -> DataFrame:
    """df with `name`: the place (from 0) of each row by a distinct order, without a task that sees all rows."""
    dealt = df.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), order).sortWithinPartitions(order)
    # within a partition this id counts from the first row; the partition's number stands above bit 33
    placed = stored(dealt.withColumn("_m", F.monotonically_increasing_id()), "ranked").withColumn("_p", F.shiftright("_m", 33))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    sizes = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(sizes), "_p").withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_before")
