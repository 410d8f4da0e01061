"""The pipeline stage by stage against plain versions, and its queries as registered."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sparkeda.llm import mixing, quality
from tests.llm.test_operators import ALNUM, brute_components, low, words

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_registered():
    q = entry.queries()
    assert "pipeline" in q and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(q)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name.replace(" ", "_")))
        before, docs = docs, spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        out[name] = (before, docs)
        if name != names[-1]:
            assert docs.dtypes == before.dtypes
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())

    before, after = out[names[0]]
    assert ids(after) == ids(quality.judge(before).where("kept"))
    before, after = out[names[1]]
    parts = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == sorted({c for _, c in parts.values()})
    before, after = out[names[2]]
    bench = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = ALNUM.findall(low(r.text))
        n = min(10, len(w))
        bench |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
    sizes = {len(b) for b in bench}
    dirty = lambda t: any(tuple(t[a : a + n]) in bench for n in sizes for a in range(len(t) - n + 1))
    assert ids(after) == sorted(r.doc_id for r in before.collect() if not dirty(ALNUM.findall(low(r.text))))
    before, after = out[names[3]]
    want = []
    for r in mixing.mix(before).collect():
        want += [r.doc_id] * (int(r.taken / r.size + 0.5) if r.size else 0)
    assert ids(after) == sorted(want)
    before, after = out[names[4]]
    assert ids(after) == ids(before) and after.where("shard IS NULL").count() == 0
    assert sum(len(words(r.text)) for r in after.collect()) > 0


def test_run_equals_its_stages_and_itself(spark):
    one = corpus_pipeline.run(spark, DATA)
    two = corpus_pipeline.run(spark, DATA)
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    assert digest(one) == digest(two)
