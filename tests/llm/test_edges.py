"""Clashing columns, nulls, repeated rows, empty tables and very long texts, in every operator and every stage."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkeda.llm import decontamination, jaccard, licences, lines, mixing, quality, scoring, sharding, substring, tokens
from tests.llm.test_operators import ALNUM, SCHEMA, VOCABULARY, base_quality, low, shingles, words

LONG = " ".join(f"q{i:x}" + ("." if i % 11 else "\n") for i in range(250_000))


def sample():
    r = random.Random(12)
    t = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    same, note = t(90), "under the MIT license " + t(80)
    rows = [(i, t(70 + i % 9), "en", "a" if i % 3 else "b", 1) for i in range(70)]
    rows += [(100, same, "en", "a", 1), (101, same, "en", "a", 1), (101, same, "en", "a", 1), (102, note, "de", None, 1), (102, same, "en", "b", 2)]
    return rows + [(None, same, None, None, None), (None, note, "en", "a", 0), (None, None, "en", "a", None), (103, None, None, None, None), (104, "", "en", "b", 0), (105, LONG, "en", "a", len(LONG))]


ROWS = sample()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


MORE = ("SLOT", "Shard", "_id", "times", "_copy", "h", "Words", "size", "g", "x0", "kept", "Component_ID", "text_hash", "_row", "_salt", "m", "a", "fp")


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with columns named like those that operators make, and like those they read but for the case."""
    return docs.select(F.lit("x").alias("DOC_ID"), F.lit("no text of this column counts").alias("Text"), *docs.columns, *[F.lit(7).alias(c) for c in MORE])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(words(ROWS[3][1])[20:45])), (2, " ".join(LONG.split()[1000:1030])), (3, None), (None, "w1 w2")], "item_id long, text string")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OPERATORS = {
    "op1": lambda d, b: tokens.token_table(d, VOCABULARY),
    "op2": lambda d, b: sharding.shard(d).select("doc_id", "slot", "shard") if "DOC_ID" not in d.columns else sharding.shard(d).toDF(*[f"c{i}" for i in range(len(sharding.shard(d).columns))]),
    "op3": lambda d, b: substring.deduplicate(d, keep_text=False),
    "op4": lambda d, b: licences.scan(d),
    "op5": lambda d, b: mixing.mix(d).select("doc_id", "size", "source_size", F.round("target", 6)),
    "op6": lambda d, b: decontamination.decontaminate(d, b),
    "op7": lambda d, b: lines.deduplicate(d, keep_text=False),
    "op8": lambda d, b: jaccard.cluster(d),
    "op9": lambda d, b: quality.judge(d),
    "op10": lambda d, b: scoring.score(d).drop("score", "base_score"),
}


@pytest.fixture(scope="module")
def plain_results(docs, bench):
    return {k: result(f(docs, bench)) for k, f in OPERATORS.items()}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_columns_change_nothing(clashing, bench, plain_results, name):
    got = OPERATORS[name](clashing, bench)
    if name == "op2":  # all columns come back, and slot and shard anew at the end
        got = got.select("c2", got.columns[-2], got.columns[-1])
    assert result(got) == plain_results[name]


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "op2"])
def test_text_ids_are_refused_by_name(spark, bench, name):
    with pytest.raises(TypeError, match="doc_id"):
        OPERATORS[name](spark.createDataFrame([("a", "t", "en", "x", 1)], SCHEMA.replace("doc_id long", "doc_id string")), bench)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_tables(spark, bench, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA), bench).count() == 0


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r[1:])
    return out


def test_values_on_nulls_repeats_and_a_long_text(plain_results):
    n = {i: sorted(len(words(t)) for k, t, *_ in ROWS if k == i) for i in (None, 101, 102, 103, 104, 105)}
    for name, at in (("op3", 0), ("op9", 0)):
        got = by_id(plain_results[name])
        assert {i: sorted(r[at] for r in got[i]) for i in n} == n, name
    assert sorted(r[0] for r in by_id(plain_results["op5"])[None]) == n[None]
    eight, nine, six, one = (by_id(plain_results[k]) for k in ("op8", "op9", "op6", "op1"))
    assert sorted(r[0] for r in eight[None]) == sorted(len(shingles(t)) for k, t, *_ in ROWS if k is None)
    assert {r[1] for r in eight[101]} == {None} and {r[1] for r in eight[103]} == {103}  # a copy under the null id comes first
    for i, t, *_ in ROWS:
        if i not in (None, 101, 102):
            assert nine[i][0][:6] == base_quality(t)
    assert six[105][0][:3] == (len(ALNUM.findall(low(LONG))), 30, 1) and six[3][0][1] == 25 and len(six[None]) == len(six[101]) == 1
    assert len(one[None]) == 3 and len(one[105]) == 1 and one[104][0][1] == 1
    ten = by_id(plain_results["op10"])
    assert ten[105][0][1] == 250_001 and ten[105][0][0] == (zlib.crc32(b"105") % 7 == 2) and len(ten[102]) == 1


@pytest.fixture(scope="module")
def folder(tmp_path_factory, bench):
    at = tmp_path_factory.mktemp("tables")
    bench.write.parquet(str(at / "benchmark.parquet"))
    return str(at)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n.split()[0] for n, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_columns_and_empty_tables(spark, docs, folder, stage, tmp_path):
    name, run = stage
    docs.select(*docs.columns, *[F.lit(7).alias(c) for c in MORE]).write.parquet(str(tmp_path / "in"))
    got = run(spark, spark.read.parquet(str(tmp_path / "in")), folder)
    want = run(spark, docs, folder)
    key = ["doc_id", "text", "lang", "source", "n_chars"]
    if name != "mixing sources":
        assert result(got.select(*key)) == result(want.select(*key))
        assert want.count() > 0
    if name == "sharding":  # columns of these names are replaced, in any case
        assert got.columns == [*docs.columns, *MORE[2:], "slot", "shard"]
    else:
        assert got.columns == spark.read.parquet(str(tmp_path / "in")).columns
    none = run(spark, docs.limit(0), folder)
    assert none.count() == 0 and none.columns[: len(key)] == key


def test_rows_of_one_id_are_told_apart(spark, folder):
    good = " ".join(f"v{i}" for i in range(80))
    rows = [(5, "short", "en", "a", 1), (5, good, "en", "a", 1), (6, good + " more", "en", "a", 1), (7, good, "en", "a", 2), (7, good, "en", "a", 2), (8, "w9 " * 3, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.quality_rules(spark, docs, folder).collect()
    assert sorted((r.doc_id, len(r.text)) for r in kept) == sorted((i, len(t)) for i, t, *_ in rows if len(t) > 100)
    alone = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    assert sorted((r.doc_id, r.text[:5]) for r in alone) == [(5, "short"), (5, good[:5]), (8, "w9 w9")]
    twice = corpus_pipeline.near_duplicates(spark, docs.where("doc_id = 7"), folder).collect()
    assert len(twice) == 1
