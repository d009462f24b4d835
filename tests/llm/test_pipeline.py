"""The stages of the corpus pipeline against plain versions, each over all that the one before it kept."""

import collections
import functools

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from flintframe.llm import mixing, toxicity

from . import brute


@pytest.fixture(scope="module")
def walked(spark, sf_dir):
    """(stage, its input, its output) of each stage, as run() applies them."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet").cache(), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir).cache()
        out.append((name, docs, made))
        docs = made
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir, walked):
    assert [name for name, _, _ in walked] == ["toxicity", "jaccard_join", "decontamination", "source_mixing", "sharding"]
    texts = [[(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] for _, docs, _ in walked]
    for _, docs, made in walked[:-1]:
        assert made.columns == docs.columns
    index = toxicity.train(walked[0][1], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(walked[0][2]) == sorted(d for d, t in texts[0] if index.score(t)[1] == 0)
    groups = {}
    for d, _, c, _ in brute.jaccard_components(texts[1], 5, 80):
        groups.setdefault(c, []).append(d)
    assert ids(walked[1][2]) == sorted(min(own) for own in groups.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert ids(walked[2][2]) == sorted(d for d, *_, bad in brute.contamination(texts[2], items) if not bad)
    assert ids(walked[3][2]) == ids(walked[2][2]) == ids(walked[4][2])
    assert walked[4][2].columns == [*walked[3][2].columns, "slot", "shard"]


def test_run(spark, sf_dir, walked):
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(walked[-1][2])


def test_run_keeps_the_mix(spark, sf_dir, walked, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.mixing, "mix", functools.partial(mixing.mix, block_rows=1))
    rows = sorted(corpus_pipeline.run(spark, sf_dir).select("position", "mix_source", "block", "slot", "shard").collect())
    assert [r.position for r in rows] == list(range(walked[3][2].count()))
    left = collections.Counter(r.mix_source for r in rows)
    total, got = sum(mixing.TARGETS[s] for s in left), collections.Counter()
    for n, r in enumerate(rows, 1):
        got[r.mix_source] += 1
        assert all(abs(got[s] - n * mixing.TARGETS[s] / total) < 1 + 1e-9 for s in left)
        if got[r.mix_source] == left[r.mix_source]:
            break
    assert n > len(left)


def test_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.isEmpty()


def test_null_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "", 0), (3, "a b c d e f g", "en", "x", 13), (4, "a b c d e f g", "en", "x", 13)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema).withColumn("slot", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(str, (r.doc_id for r in docs.collect()))) == ["1", "1", "2", "3", "None"]
