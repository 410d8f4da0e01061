"""Operator 7: line deduplication by winnowing over line hashes (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.llm.shared import NO_ID, discard, hot_keys, keyed_texts, real_id, repeated_salts, salted, stored

HAS_WORD = r"[^\x20\x09-\x0D]"


def fingerprints(hashed: DataFrame, run: int) -> DataFrame:
    """(doc_id, pos, fp): of each `run` consecutive lines the one with the smallest hash, the first on ties, once."""
    placed = F.transform("h", lambda h, i: F.struct(h.alias("fp"), i.alias("pos")))
    least = F.transform(F.sequence(F.lit(1), F.size("h") - run + 1), lambda i: F.array_min(F.slice("p", i, run)))
    return hashed.where(F.size("h") >= run).withColumn("p", placed).select("doc_id", F.explode(F.array_distinct(least)).alias("f")).select("doc_id", "f.pos", "f.fp")


def among(rows: DataFrame, counts: DataFrame, keys: list[str], facts: DataFrame) -> DataFrame:
    """rows joined with facts (one row per key); rows of a hot key are dealt to several tasks. counts: (keys, n)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = stored(hot_keys(counts, keys, total), "line-hot")
    return salted(rows, hot, keys, F.xxhash64("doc_id", "pos")).join(repeated_salts(facts, hot, keys), [*keys, "salt"]).drop("salt")


def window(start: Column, size: Column) -> Column:
    """A window of line hashes: where it starts, how many lines it has, and two hashes, 96 bits, of what they are."""
    return F.struct(start.alias("pos"), size.alias("m"), F.xxhash64(F.slice("h", start + 1, size)).alias("a"), F.hash(F.slice("g", start + 1, size)).alias("b"))


def deduplicate(docs: DataFrame, run: int = 3, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, long_words: int | None = None, whole: bool = False) -> DataFrame:
    """Delete later repeats of runs of at least `run` consecutive lines.

    Lines are the parts of the whole text between \\n; only those with a word ([^\\x20\\x09-\\x0D]+)
    count, the others stay where they are. A run is deleted where each of its windows of `run` lines
    also starts earlier: in a document with a smaller doc_id, or before it in the same document.
    With long_words a line of that many words or more is a window by itself; with `whole` a document of
    fewer lines than `run` is one window.

    Winnowing: of each window the line with the smallest hash is its fingerprint, so equal runs share
    one, and only fingerprints are put out. Those at two places or more are joined back to the lines of
    their documents and extended both ways, to the windows they lie in; these are compared by two hashes
    (96 bits) of their lines, and windows that touch make up the longest run. No pairs are made: of a
    window the first position is kept, as a partial aggregate, and a hot line or window is dealt to several tasks.

    Returns doc_id, n_lines (with a word), n_removed, kept_sha256 (of the lines kept, joined by \\n)
    and, with keep_text, kept_text. Null text is empty. A null doc_id is the smallest. Rows that repeat
    a doc_id share its positions: equal rows stay alike, and of different ones a line is removed if
    its position is removed in either. An empty table gives an empty one.
    """
    base = keyed_texts(docs, doc_id, text).select("doc_id", F.split("text", "\n").alias("all"))
    full = base.select("doc_id", F.filter("all", lambda x: x.rlike(HAS_WORD)).alias("lines"))
    hashes = [F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.hash(x)).alias("g")]
    if long_words:
        counted = F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))
        hashes.append(F.array_compact(F.transform(counted, lambda n, i: F.when(n >= long_words, i))).alias("long"))
    hashed = stored(full.select("doc_id", *hashes).where(F.size("h") >= (1 if long_words or whole else run)), "line-hashes")

    prints = stored(fingerprints(hashed, run), "line-prints")
    counts = stored(prints.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"), "line-shared")
    met = among(prints, counts, ["fp"], counts.select("fp"))
    spots = met.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    joined = hashed.join(spots, "doc_id")
    first, last = (lambda p: F.greatest(p - (run - 1), F.lit(0))), (lambda p: F.least(p, F.size("h") - run))
    around = F.array_distinct(F.flatten(F.transform(F.filter("at", lambda p: F.size("h") - run >= first(p)), lambda p: F.sequence(first(p), last(p)))))
    found = joined.select("doc_id", F.explode(F.transform(around, lambda i: window(i, F.lit(run)))).alias("w"))
    if long_words:
        found = found.unionByName(hashed.select("doc_id", F.explode(F.transform("long", lambda i: window(i, F.lit(1)))).alias("w")))
    if whole:
        found = found.unionByName(hashed.where(F.size("h") < run).select("doc_id", window(F.lit(0), F.size("h")).alias("w")))
    windows = stored(found.select("doc_id", "w.*"), "line-windows")
    seen = windows.groupBy("m", "a", "b").agg(F.min(F.struct("doc_id", "pos")).alias("lo"), F.max(F.struct("doc_id", "pos")).alias("hi"), F.count("*").alias("n"))
    seen = stored(seen.where("lo <> hi").drop("hi"), "line-first")
    later = among(windows, seen, ["m", "a", "b"], seen.drop("n")).where(F.struct("doc_id", "pos") > F.col("lo"))
    cut = stored(later.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "m")).alias("cut")), "line-cut")
    discard(prints, counts, hashed, windows, seen)

    # texts are dealt by doc_id at every size, neither sorted nor broadcast to
    marked = base.join(cut.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "all", F.coalesce("cut", F.array().cast("array<struct<pos:int,m:int>>")).alias("cut"), F.array_compact(F.transform("all", lambda x, i: F.when(x.rlike(HAS_WORD), i))).alias("places"))
    gone = F.array_distinct(F.flatten(F.transform("cut", lambda w: F.slice("places", w["pos"] + 1, w["m"]))))
    marked = marked.select("doc_id", "all", F.size("places").cast("long").alias("n_lines"), gone.alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    out = marked.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.transform(kept, lambda i: F.get("all", i)), "\n").alias("kept_text"))
    return out.select(real_id(), "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), *(["kept_text"] if keep_text else []))


def oracle(run: int = 3) -> str:
    return rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS al FROM documents),
l AS (SELECT doc_id, i, al[i + 1] AS line FROM (SELECT doc_id, al, unnest(range(len(al))) AS i FROM d) WHERE regexp_matches(al[i + 1], '[^\x20\x09-\x0D]')),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
g AS (SELECT doc_id, list(line ORDER BY k) AS ls FROM o GROUP BY doc_id),
w AS (SELECT doc_id, k, ls[k : k + {run - 1}] AS win FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - {run - 2})) AS k FROM g WHERE len(ls) >= {run})),
f AS (SELECT win, min((doc_id, k)) AS lo FROM w GROUP BY win),
c AS (SELECT DISTINCT w.doc_id, unnest(range(w.k, w.k + {run})) AS k FROM w JOIN f USING (win) WHERE (w.doc_id, w.k) <> f.lo),
x AS (SELECT o.doc_id, o.i FROM c JOIN o USING (doc_id, k)),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(len(al)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: al[i + 1]), chr(10))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)"""


def passages_oracle(run: int = 3, long_words: int = 50) -> str:
    """The same with single lines of long_words words or more, and documents of fewer lines than run, as windows."""
    return rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS al FROM documents),
l AS (SELECT doc_id, i, al[i + 1] AS line FROM (SELECT doc_id, al, unnest(range(len(al))) AS i FROM d) WHERE regexp_matches(al[i + 1], '[^\x20\x09-\x0D]')),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
g AS (SELECT doc_id, list(line ORDER BY k) AS ls FROM o GROUP BY doc_id),
w AS (SELECT doc_id, k, ls[k : k + {run - 1}] AS win FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - {run - 2})) AS k FROM g WHERE len(ls) >= {run})
  UNION ALL SELECT doc_id, 1, ls FROM g WHERE len(ls) < {run}
  UNION ALL SELECT doc_id, k, [line] FROM o WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {long_words}),
f AS (SELECT win, min((doc_id, k)) AS lo FROM w GROUP BY win),
c AS (SELECT DISTINCT w.doc_id, unnest(range(w.k, w.k + len(w.win))) AS k FROM w JOIN f USING (win) WHERE (w.doc_id, w.k) <> f.lo),
x AS (SELECT o.doc_id, o.i FROM c JOIN o USING (doc_id, k)),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(len(al)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: al[i + 1]), chr(10))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)"""
