"""The neighbours of the block-max index against all cosines, and the scores of hard texts and held-out rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flintframe.llm import queries, toxicity


def made_index(seed, n=300, size=80):
    rnd = random.Random(seed)
    vectors = []
    for _ in range(n):
        at = sorted(rnd.sample(range(size), rnd.randrange(0, 9)))
        vectors.append((at, [rnd.randrange(1, 5) for _ in at]))
    vectors += vectors[:20]
    labels = [rnd.randrange(2) for _ in vectors]
    idf = np.asarray([1 + rnd.random() for _ in range(size)])
    vocabulary = {f"t{k}": k for k in range(size)}
    return toxicity.build([f"{k:04}" for k in range(len(vectors))], labels, vectors, vocabulary, idf, (labels.count(0), labels.count(1))), vectors, labels, idf


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_is_exact(seed):
    index, vectors, labels, idf = made_index(seed)
    dense = np.zeros((len(vectors), len(idf)))
    for k, (at, n) in enumerate(vectors):
        dense[k, at] = (1 + np.log(np.asarray(n, float))) * idf[at] if at else 0
    dense /= np.maximum(np.sqrt((dense * dense).sum(axis=1, keepdims=True)), 1e-12)
    rnd = random.Random(seed + 50)
    for _ in range(60):
        text = " ".join(f"t{rnd.randrange(90)}" for _ in range(rnd.randrange(0, 12)))
        at, x = index.vector(text)
        query = np.zeros(len(idf))
        query[at] = x
        cosines = dense @ query
        top = sorted((c for c in cosines if c > 0), reverse=True)
        kth = top[min(len(top), toxicity.NEIGHBOURS) - 1] if top else 0
        expected = sorted(f"{k:04}" for k, c in enumerate(cosines) if c > 0 and c >= kth - 1e-9)
        docs, scores = index.nearest(at, x)
        assert sorted(index.ids[d] for d in docs) == expected
        assert all(abs(cosines[int(index.ids[d])] - s) < 1e-9 for d, s in zip(docs, scores, strict=True))


def test_hard_texts(spark):
    bad = [(k, f"you vile rotten scum number {k}", 1) for k in range(40)]
    good = [(100 + k, f"a calm walk along the river {k}", 0) for k in range(60)]
    rows = [(k, t) for k, t, _ in bad + good]
    hard = [(900, None), (901, ""), (902, " \n"), (903, "wörd 日本 😀"), (904, "vile scum " * 20000), (905, bad[0][1]), (905, bad[0][1]), (None, good[0][1])]
    table = spark.createDataFrame(rows + hard, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, y) for k, _, y in bad + good] + [(None, 1), (900, None), (100, 0)], "doc_id bigint, toxic int")
    index = toxicity.train(table, labels)
    out = {}
    for r in table.select("doc_id", toxicity.judged(F.col("text"), index).alias("r")).collect():
        out.setdefault(r.doc_id, []).append((r.r.score, r.r.predicted))
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for own in out.values() for s, p in own)
    assert all(out[k][0][1] == 1 for k in [*range(40), 904, 905]) and all(out[100 + k][0][1] == 0 for k in range(60))
    assert out[900] == out[901] == out[902] and out[905][0] == out[905][1] and len(out[905]) == 2
    none = toxicity.train(table, labels.limit(0))
    assert {r.r.score for r in table.select(toxicity.judged(F.col("text"), none).alias("r")).collect()} == {0.0}
    assert table.limit(0).select(toxicity.judged(F.col("text"), index)).isEmpty()


def test_cosines_of_whole_texts(spark):
    rnd = random.Random(8)
    texts = [(k, " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 40)))) for k in range(120)]
    asked = [(k + 2000, f"{t} never seen words") for k, t in texts[60:]] + [(k + 1000, t) for k, t in texts[:60]]
    docs = spark.createDataFrame(texts + asked, "doc_id bigint, text string")
    index = toxicity.train(docs, spark.createDataFrame([(k, int(k < 6)) for k in range(60)], "doc_id bigint, toxic int"))
    seen = docs.collect()
    df = {}
    for r in seen:
        for t in toxicity.terms(r.text):
            df[t] = df.get(t, 0) + 1

    def vector(text):
        x = {t: (1 + np.log(n)) * (np.log((1 + len(seen)) / (1 + df[t])) + 1) for t, n in toxicity.terms(text).items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        return {t: v / norm for t, v in x.items()}

    examples = {k: vector(t) for k, t in texts[:60]}
    for r in seen:
        own = vector(r.text)
        cosines = {k: sum(v * own.get(t, 0) for t, v in x.items()) for k, x in examples.items()}
        kth = sorted(cosines.values())[-toxicity.NEIGHBOURS]
        docs, scores = index.nearest(*index.vector(r.text))
        got = {int(index.ids[d]): s for d, s in zip(docs, scores, strict=True)}
        assert set(got) == {k for k, c in cosines.items() if c > 0 and c >= kth - 1e-9}
        assert all(abs(cosines[k] - s) < 1e-4 for k, s in got.items())
        if 1000 <= r.doc_id < 2000:
            assert got[r.doc_id - 1000] > 1 - 1e-6


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op10_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "toxic").where("toxic is not null").collect()
    yes, no = [r.score for r in out if r.toxic == 1], [r.score for r in out if r.toxic == 0]
    assert len(yes) > 20 and len(no) > 20
    better = sum((a > b) + (a == b) / 2 for a in yes for b in no)
    assert better >= 0.9 * len(yes) * len(no)


def test_votes_and_calibration():
    index, _, _, _ = made_index(5)
    docs, scores = np.asarray([0, 3, 7]), np.asarray([1.0, 0.5, 0.2])
    w = [1 / 0.05, 1 / 0.55, 1 / 0.85]
    assert abs(index.vote(docs, scores) - sum(a * index.labels[d] for a, d in zip(w, docs)) / sum(w)) < 1e-12
    assert index.vote(docs[:0], scores[:0]) is None
    rnd = np.random.default_rng(4)
    v = rnd.random(200)
    y = (rnd.random(200) < v**2).astype(int)
    weight = np.where(y == 1, 2.0, 5.0)
    a, b = toxicity.calibrated(v, y, weight)
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * v + b)))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() + 0.5e-2 * ((a - 8) ** 2 + (b + 4) ** 2)

    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_a_copy_of_a_toxic_example_is_near_it(spark):
    rnd = random.Random(11)
    texts = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, texts[3])], "doc_id bigint, text string")
    index = toxicity.train(docs, spark.createDataFrame([(k, int(k < 8)) for k in range(60)], "doc_id bigint, toxic int"))
    assert index.score(texts[3])[2][0]["id"] == "3" and index.score(texts[3])[2][0]["similarity"] > 1 - 1e-6
