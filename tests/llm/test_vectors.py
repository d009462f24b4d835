"""Top-k search, vector codes and resampling against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flintframe.llm import bitslices, codes, importance, queries
from flintframe.llm.common import table

from .brute import ITEM_WORD, UPPER

VECTORS = "vec_id bigint, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def whole(vector):
    return [max(-(1 << 26), min(1 << 26, math.floor(256 * x))) for x in vector]


def fine(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def plain_top(rows, asked, k):
    own = [(i, whole(v)) for i, v in rows if fine(v)]
    out = []
    for q, v in {(i, tuple(whole(v))) for i, v in asked if i is not None and fine(v)}:
        scored = sorted(((-sum(a * b for a, b in zip(v, c)), i is None, i) for i, c in own if i != q))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def plain_codes(rows, parts, entries, rounds):
    kept = sorted(((i is None, i, tuple(whole(v)), y) for i, v, y in rows if fine(v)), key=lambda r: (r[0], r[1] or 0, r[2]))
    step = -(-max((len(v) for _, _, v, _ in kept), default=0) // parts)
    cut = [[(list(v) + [0] * (parts * step - len(v)))[p * step : (p + 1) * step] for p in range(parts)] for _, _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [near(c[p], book)[1] for c in cut]
            books[p] = [[sum(col) // len(col) for col in zip(*own)] if (own := [c[p] for c, e in zip(cut, held) if e == k]) else old for k, old in enumerate(book)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sums = Counter()
    for (_, _, _, y), e in zip(kept, errors):
        sums[y] += e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, sums[y]) for (_, i, _, y), f, err in zip(kept, found, errors)), key=str), books


def hard_vectors(spark, n=230, wide=6):
    rnd = random.Random(4)
    rows = [(k, [round(rnd.uniform(-1, 1), 2) for _ in range(wide)], k % 3 if k % 7 else None) for k in range(n)]
    rows += [(1000 + k, rows[50][1], 1) for k in range(40)]  # one vector that many rows share
    rows += [rows[100], rows[100], (None, [0.5] * wide, None), (2000, None, 1), (2001, [NAN] + [0.0] * (wide - 1), 1), (2002, [None] * wide, 2), (2003, [INF] * wide, 2)]
    rows += [(2050, [], 5), (2100, [1.0], 5), (2150, [3e38, -3e38, 7000000.0], 5), (2200, [0.0] * wide, 5)]
    return rows, spark.createDataFrame(rows, VECTORS)


def test_top_k_of_hard_rows(spark):
    rows, df = hard_vectors(spark)
    asked = [(i, v) for i, v, _ in rows if i is not None and i % 50 == 0]
    want = plain_top([(i, v) for i, v, _ in rows], asked, 5)
    for blocks, chunk in ((bitslices.BLOCK_ROWS, bitslices.CHUNK_QUERIES), (37, 3)):
        got = bitslices.search(df.withColumn("__id", F.lit(1)), df.where("vec_id % 50 = 0"), 5, blocks, chunk)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_top_k_of_few_rows(spark):
    few = spark.createDataFrame([(0, [0.5, 1.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], VECTORS)
    assert [tuple(r) for r in bitslices.search(few, few.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(0, 1, 1, 128 * 256), (0, 2, None, 128 * 256)]
    none = few.limit(0)
    assert bitslices.search(none, few, 5).count() == bitslices.search(few, none, 5).count() == bitslices.search(none, none, 5).count() == 0
    alone = few.where("vec_id = 0")
    assert bitslices.search(alone, alone, 5).count() == 0


def test_slices_add_up():
    rnd = np.random.default_rng(0)
    for bound in (1, 3, 300, 1 << 26):
        x = rnd.integers(-bound, bound, (130, 9))
        block = bitslices.Block.of(np.arange(130), 130, x)
        for q in (rnd.integers(-bound, bound, 9), np.zeros(9, int), np.eye(9, dtype=int)[3] * -bound):
            rows, scores = block.best(q, 5, 20)
            want = sorted((-int(s), k) for k, s in enumerate(x @ q) if k != 5)[:20]
            assert sorted(zip((-scores).tolist(), rows.tolist())) == want


def test_top_k_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    assert sorted(map(tuple, queries.op11_bitslice_topk(spark, sf_dir).collect()), key=str) == plain_top(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_annuli_hold_the_nearest():
    rnd = np.random.default_rng(1)
    for bound, n in ((2, 40), (50, 64), (1 << 26, 256), (3, 1)):
        book, x = rnd.integers(-bound, bound, (n, 4)), rnd.integers(-bound, bound, (500, 4))
        index, distance = codes.Annuli(book).nearest(x)
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_codes_of_hard_rows(spark):
    rows, df = hard_vectors(spark)
    want, books = plain_codes(rows, 3, 20, 2)
    got, found = codes.compress(df.repartition(5).withColumn("code", F.lit("x")).withColumn("__v", F.lit(2)), 3, 20, 2)
    assert sorted(map(tuple, got.collect()), key=str) == want and found.tolist() == books
    few = df.where("vec_id < 3")
    assert sorted(map(tuple, codes.compress(few, 2, 64, 1)[0].collect())) == plain_codes(rows[:3], 2, 64, 1)[0]
    empty, none = codes.compress(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error"] and codes.digest(none) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        codes.compress(df, entries=300)


def test_codes_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf_dir, "embeddings").collect()]
    want, books = plain_codes(rows, 16, 64, 2)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert sorted(map(tuple, queries.op12_annular_codes(spark, sf_dir).collect()), key=str) == [(*w, sha) for w in want]


def plain_resample(docs, target, percent=10, longest=1, buckets=10_000, least=20, seed=2024):
    def runs(text):
        ws = ITEM_WORD.findall((text or "").translate(UPPER))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    own, goal = [runs(t) for _, t in docs], Counter(b for t in target for b in runs(t)[1])
    all_own = Counter(b for _, f in own for b in f)
    s, t = sum(all_own.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((all_own[b] + 1) * (t + buckets))))
    rows = []
    for (doc, _), (n, f) in zip(docs, own):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resampling_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    target = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    assert sorted(map(tuple, queries.op13_importance_resampling(spark, sf_dir).collect()), key=str) == plain_resample(docs, target)


def test_resampling_of_hard_rows(spark):
    rnd = random.Random(3)
    said = lambda n: " ".join(rnd.choice(("Stone", "flint", "core", "ünder", "x9", "a-b", "long" * 40)) for _ in range(n))
    docs = [(k, said(rnd.randrange(0, 40))) for k in range(-20, 60)] + [(70, None), (71, ""), (72, " \n-!"), (73, said(30_000)), (None, said(50)), (9223372036854775807, said(30)), (-9223372036854775808, said(30))]
    docs += [(500, said(25))] * 60  # one id and text that many rows share
    target = ["flint core flint", None, "", "Core ünder"]
    df, goal = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    for longest in (1, 3):
        for percent in (0, 1, 30, 100):
            got = importance.resample(df.withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).repartition(5), goal, percent, longest, 997)
            found = sorted(map(tuple, got.collect()), key=str)
            assert found == plain_resample(docs, target, percent, longest, 997)
    assert importance.resample(df.limit(0), goal).count() == 0
    assert {r.rank for r in importance.resample(df, goal.limit(0), 100, least_words=0).collect()} == set(range(1, len(docs) + 1))


def test_selection_by_digits(spark):
    rnd = random.Random(5)
    for spread in (2, 1000, 1 << 62):
        rows = [(rnd.randrange(-spread, spread), rnd.choice((-5, 7, (1 << 63) - 1, -(1 << 63))), k) for k in range(300)]
        df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").cache()
        parts = [("a", True), ("b", False), ("c", False)]
        order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
        for k, bits in ((1, 12), (150, 3), (150, 12), (300, 12)):
            key = importance.kth(df, parts, k, bits)
            assert sorted(map(tuple, df.where(importance.upto(parts, key)).collect())) == sorted(order[:k])
        assert importance.kth(df, parts, 0) is None and importance.kth(df, parts, 301) is None
        assert [r[2] for r in sorted(importance.ranked(df, parts).collect(), key=lambda r: r["rank"])] == [r[2] for r in order]
        df.unpersist()


def test_hashes_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["Hello world", "", None, "ends", "begins x\x00y " + "z" * 200, "É9 ab-cd"] * 5
    for piece in (1, 17, 1 << 22):
        monkeypatch.setattr(importance, "PIECE", piece)
        for longest in (1, 2):
            got = []
            for first, data, offsets in importance._pieces(pa.array(["off", *texts]).slice(1)):
                t, b, _ = importance.hashed(data, offsets, longest, 1 << 32)
                got += zip((t + first).tolist(), b.tolist())
            want = [(k, zlib.crc32(" ".join(ws[i : i + n]).encode())) for k, x in enumerate(texts) for ws in [ITEM_WORD.findall((x or "").translate(UPPER))] for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]
            assert sorted(got) == sorted(want)
