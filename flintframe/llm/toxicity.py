"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Weights are TF-IDF over all words of whole texts; words that the labels make telling weigh more
(BOOST), as a few insults in a long text would else hardly turn its cosines. README has held-out figures.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

#: Labelled rows of each class that the classifier is fitted on (about), examples in a block, neighbours.
EXAMPLES, BLOCK, NEIGHBOURS = 1000, 64, 15
#: Blocks that are scored before the others are held against the k-th cosine, and cells that count terms of no example.
FIRST_BLOCKS, CELLS = 8, 1 << 18
#: A term that one in OFTEN examples has is kept as a row of a matrix; texts that are scored together.
OFTEN, AT_ONCE = 8, 64
#: Terms that tell labels apart (chi-square over the examples, and examples that have it) weigh BOOST-fold.
LEAST_CHI2, LEAST_EXAMPLES, BOOST = 25.0, 3, 8.0
#: Words of no example, and texts whose scores, a task keeps in mind.
MOST_KNOWN, MOST_JUDGED = 100_000, 2000
_WORD = re.compile(r"\w+")
RESULT = "struct<score:double,predicted:int,evidence:array<struct<id:string,label:int,similarity:float>>>"


def terms(text: str | None) -> Counter:
    """Counts of the words of the whole lower-cased text."""
    return Counter(_WORD.findall((text or "").lower()))


def _cell(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % CELLS


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of n[0] numbers, then those from first[1] and so on."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    """Postings by term and block, block maxima, labels, and the calibration of votes.

    An entry is a term in a block: its postings and their greatest weight. Terms that at least one example in OFTEN
    has are kept as rows of a matrix instead, with their block maxima beside it. ``rest`` is the idf of terms that no
    example has, by cell; they count for the length of a text's vector only.
    """

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: list[str] = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # term -> first entry
    block: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))  # of each entry
    most: np.ndarray = field(default_factory=lambda: np.empty(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))  # entry -> first posting
    doc: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    row: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # term -> row of often, or -1
    often: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))  # term x example
    often_most: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))  # term x block
    rest: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.0

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and TF-IDF weights of a whole text, normalised by all its terms; both empty if no example has one of them."""
        return _Reader(self).vector(text)

    def nearest(self, at: np.ndarray, x: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest with a positive cosine and of all as near as the last of them."""
        return self.neighbours([(at, x)], k)[0]

    def neighbours(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of several vectors at once, each without the example in skip.

        A block's bound is a query's product with its maxima. The blocks of the greatest bounds are scored exactly,
        then all others whose bound reaches the k-th cosine of these.
        """
        n, size = len(self.ids), len(vectors)
        if not n or not size:
            return [(np.empty(0, np.int64), np.empty(0))] * size
        blocks = -(-n // BLOCK)
        t, x = np.concatenate([at for at, _ in vectors]).astype(np.int64), np.concatenate([w for _, w in vectors])
        query = np.repeat(np.arange(size), [len(at) for at, _ in vectors])
        dense = self.row[t] >= 0
        common = np.zeros((size, len(self.often)))
        common[query[dense], self.row[t[dense]]] = x[dense]
        t, x, query = t[~dense], x[~dense], query[~dense]
        runs = self.starts[t + 1] - self.starts[t]
        entry, x, query = _runs(self.starts[t], runs), np.repeat(x, runs), np.repeat(query, runs)
        block = self.block[entry]
        bounds = common @ self.often_most + np.bincount(query * blocks + block, self.most[entry] * x, size * blocks).reshape(size, blocks)
        take = np.zeros(bounds.shape, bool)
        np.put_along_axis(take, np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        done, scores = np.zeros(bounds.shape, bool), np.zeros((size, n))
        while take.any():
            own = take[query, block]
            lo = self.first[entry[own]]
            runs = self.first[entry[own] + 1] - lo
            at = _runs(lo, runs)
            scores += np.bincount(np.repeat(query[own] * n, runs) + self.doc[at], self.weight[at] * np.repeat(x[own], runs), size * n).reshape(size, n)
            for j in np.flatnonzero(take.any(axis=0)):
                own = np.flatnonzero(take[:, j])
                scores[own, j * BLOCK : (j + 1) * BLOCK] += common[own] @ self.often[:, j * BLOCK : (j + 1) * BLOCK]
            done |= take
            if skip is not None:
                scores[np.arange(size), skip] = 0
            kth = np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.zeros(size)
            take = ~done & (bounds > 0) & (bounds >= kth[:, None] - 1e-9)
        found = []
        for own, least in zip(scores, kth, strict=True):
            docs = np.flatnonzero((own > 0) & (own >= least - 1e-9))
            order = np.lexsort((docs, -own[docs]))
            found.append((docs[order], own[docs[order]]))
        return found

    def vote(self, docs: np.ndarray, scores: np.ndarray) -> float | None:
        """Share of label 1 among the neighbours, each weighing one over its distance; none without neighbours."""
        if not len(docs):
            return None
        w = 1 / (0.05 + np.maximum(0.0, 1 - scores))
        return float(w @ self.labels[docs] / w.sum())

    def scores(self, texts: list[str | None], reader: _Reader | None = None) -> list[tuple[float, int, list[dict]]]:
        """Calibrated score, prediction, and the nearest examples. Without a known term the score is that of such examples."""
        reader, out = reader or _Reader(self), []
        for lo in range(0, len(texts), AT_ONCE):
            for docs, cosines in self.neighbours([reader.vector(t) for t in texts[lo : lo + AT_ONCE]]):
                vote = self.vote(docs, cosines)
                p = self.prior if vote is None else float(1 / (1 + np.exp(-(self.slope * vote + self.offset))))
                out.append((p, int(p >= 0.5), [{"id": self.ids[d], "label": int(self.labels[d]), "similarity": float(s)} for d, s in zip(docs[:NEIGHBOURS], cosines[:NEIGHBOURS], strict=True)]))
        return out

    def score(self, text: str | None) -> tuple[float, int, list[dict]]:
        return self.scores([text])[0]


class _Reader:
    """Vectors of texts; words of no example that were met before are kept in mind, as numbers after the vocabulary's."""

    def __init__(self, index: Index) -> None:
        self._index, self._known = index, index.vocabulary.copy()
        self._idf = np.concatenate((index.idf, np.zeros(MOST_KNOWN)))

    def _number(self, word: str) -> int:
        """The number of a word that is not in mind: the next one."""
        size = len(self._known)
        if size >= len(self._idf):
            self._idf = np.concatenate((self._idf, np.zeros(size)))
        self._idf[size] = self._index.rest[_cell(word)] if self._index.rest is not None else 0.0
        self._known[word] = size
        return size

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        said, size = terms(text), len(self._index.idf)
        if len(self._known) > size + MOST_KNOWN:
            self._known = self._index.vocabulary.copy()
        get = self._known.get
        at = np.fromiter([k if (k := get(w)) is not None else self._number(w) for w in said], np.int64, len(said))
        x = (1 + np.log(np.fromiter(said.values(), float, len(said)))) * self._idf[at]
        x /= max(float(np.sqrt(x @ x)), 1e-12)
        own = at < size
        return at[own], x[own]


def build(ids: list[str], labels: list[int], vectors: list[tuple[list[int], list[int]]], vocabulary: dict[str, int], idf: np.ndarray, class_rows: tuple[int, int], rest: np.ndarray | None = None) -> Index:
    """The index over examples given as (terms, counts), with votes calibrated to the true class sizes.

    Examples lie in blocks by their heaviest term, so that maxima are tight. Each example's own vote, without itself,
    and its label fit a logistic curve; classes weigh as in all labelled rows.
    """
    index = Index(vocabulary, idf, rest=rest)
    made = []
    for at, n in vectors:
        x = (1 + np.log(np.asarray(n, float))) * idf[at] if len(at) else np.empty(0)
        made.append((np.asarray(at, np.int64), x / max(float(np.sqrt(x @ x)), 1e-12)))
    order = sorted(range(len(ids)), key=lambda k: (int(made[k][0][made[k][1].argmax()]) if len(made[k][0]) else -1, ids[k]))
    index.ids, index.labels = [ids[k] for k in order], np.asarray([labels[k] for k in order], np.int32)
    made = [made[k] for k in order]
    blocks = -(-len(ids) // BLOCK)
    t = np.concatenate([at for at, _ in made] or [np.empty(0, np.int64)])
    d = np.repeat(np.arange(len(made)), [len(at) for at, _ in made])
    w = np.concatenate([x for _, x in made] or [np.empty(0)])
    common = np.flatnonzero(np.bincount(t, minlength=len(vocabulary)) * OFTEN >= max(1, len(ids)))
    index.row = np.full(len(vocabulary), -1)
    index.row[common] = np.arange(len(common))
    index.often = np.zeros((len(common), len(ids)))
    dense = index.row[t] >= 0
    index.often[index.row[t[dense]], d[dense]] = w[dense]
    index.often_most = np.maximum.reduceat(index.often, np.arange(0, len(ids), BLOCK), axis=1) if len(ids) else np.zeros((len(common), 0))
    t, d, w = t[~dense], d[~dense], w[~dense]
    sort = np.lexsort((d, t))
    t, index.doc, index.weight = t[sort], d[sort].astype(np.int32), w[sort]
    key = t * blocks + index.doc // BLOCK
    new = np.flatnonzero(np.diff(key, prepend=-1))
    index.first = np.append(new, len(key)).astype(np.int32)
    index.starts, index.block = np.searchsorted(t[new], np.arange(len(vocabulary) + 1)), (index.doc[new] // BLOCK).astype(np.int32)
    index.most = np.maximum.reduceat(index.weight, new) if len(new) else np.empty(0)
    share = [rows / max(1, int((index.labels == c).sum())) for c, rows in enumerate(class_rows)]
    silent = [share[c] * sum(1 for (at, _), y in zip(made, index.labels, strict=True) if y == c and not len(at)) for c in (0, 1)]
    index.prior = (silent[1] + 0.01) / (sum(silent) + 1) if sum(class_rows) else 0.0
    votes = []
    for lo in range(0, len(made), AT_ONCE):
        part = np.arange(lo, min(lo + AT_ONCE, len(made)))
        own = index.neighbours([made[k] for k in part], skip=part)
        votes += [(v, y) for near, y in zip(own, index.labels[part], strict=True) if (v := index.vote(*near)) is not None]
    if votes:
        v, y = np.asarray([a for a, _ in votes]), np.asarray([b for _, b in votes])
        weight = np.asarray(share)[y]
        index.slope, index.offset = calibrated(v, y, weight)
    return index


def calibrated(v: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of weighted votes v against labels y, with smoothed targets and a slight pull to 8 and -4."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 8.0, -4.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p)
        hessian = np.array([[h @ (v * v) + 1e-2, h @ v], [h @ v, h.sum() + 1e-2]])
        step = np.linalg.solve(hessian, [g @ v + 1e-2 * (a - 8), g.sum() + 1e-2 * (b + 4)])
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def telling(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int) -> np.ndarray:
    """Which terms tell the labels apart: chi-square of presence and label of LEAST_CHI2 or more, in LEAST_EXAMPLES or more."""
    have = np.zeros((2, size))
    for (at, _), y in zip(vectors, labels, strict=True):
        have[y, at] += 1
    n1, n = max(1, int(labels.sum())), len(labels)
    n0, df = max(1, n - n1), have.sum(axis=0)
    chi2 = n * (have[1] * (n0 - have[0]) - have[0] * (n1 - have[1])) ** 2 / np.maximum(1.0, n1 * n0 * df * (n - df))
    return (chi2 >= LEAST_CHI2) & (df >= LEAST_EXAMPLES)


_COUNTED = "id string, y int, at binary, n binary"


def _index(counted: DataFrame, vocabulary: dict[str, int], idf: np.ndarray, sizes: dict[int, int], rest: np.ndarray | None) -> Index:
    rows = sorted(counted.collect(), key=lambda r: (r["id"], r["at"], r["n"]))
    vectors, labels = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32)) for r in rows], [r["y"] for r in rows]
    idf = np.where(telling(vectors, np.asarray(labels, np.int64), len(vocabulary)), BOOST, 1.0) * idf
    return build([r["id"] for r in rows], labels, vectors, vocabulary, idf, (sizes.get(0, 0), sizes.get(1, 0)), rest)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """An index over about EXAMPLES labelled documents of each class, drawn by hash of the id.

    labels: id and label 0 or 1; null ids and labels are left out, and of several labels of an id the greatest counts.
    All terms of the examples are in the index; idf comes from all documents, and is BOOST-fold for terms that tell
    the examples' labels apart, so cosines are exact under these weights. Only the examples' terms and a count for each
    and for each cell reach the driver, so what it holds depends on the examples and not on the documents. Null and
    blank texts have no terms; very long texts count whole; repeated rows of an id are examples each; examples are
    ordered by id, so ties do not depend on the partitions. Without labels the index is empty.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    sizes = {r["__y"]: r["count"] for r in own.groupBy("__y").count().collect()}  # a row a class
    draw = F.pmod(F.xxhash64(F.lit(2), id_col), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("__y") == 1, min(1.0, EXAMPLES / max(1, sizes.get(1, 0)))).otherwise(min(1.0, EXAMPLES / max(1, sizes.get(0, 0))))
    drawn = own.where(draw < share).withColumnRenamed(id_col, "__id")
    sample = durable(docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("__d") == F.col("__id")).select(F.col("__id").cast("string").alias("id"), "__y", "text"))

    def worded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"term": pd.Series(sorted(set().union(*map(terms, b["text"]))), dtype=object)})

    vocabulary = {t: k for k, t in enumerate(sorted(sample.select("text").mapInPandas(worded, "term string").distinct().toArrow()["term"].to_pylist()))}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [sorted((vocabulary[t], n) for t, n in terms(x).items()) for x in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "y": batch["__y"], "at": [np.asarray([k for k, _ in m], np.int32).tobytes() for m in made], "n": [np.asarray([n for _, n in m], np.int32).tobytes() for m in made]})

    def tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents with each term (its number) or cell (numbers after those), and all of them as number -1."""
        seen, rows, size = np.zeros(len(vocabulary) + CELLS, np.int64), 0, len(vocabulary)
        for batch in batches:
            rows += len(batch)
            for text in batch["text"]:
                own = {k if (k := vocabulary.get(w)) is not None else size + _cell(w) for w in terms(text)}
                seen[np.fromiter(own, np.int64, len(own))] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(seen[at], rows)})

    if not vocabulary:
        return _index(sample.mapInPandas(counted, _COUNTED), {}, np.empty(0), sizes, None)
    seen = docs.select(F.col(text_col).alias("text")).mapInPandas(tallied, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    seen = {c: seen[c].to_numpy() for c in ("at", "n")}
    found = np.zeros(len(vocabulary) + CELLS)
    found[seen["at"][seen["at"] >= 0]] = seen["n"][seen["at"] >= 0]
    idf = np.log((1 + float(seen["n"][seen["at"] < 0].sum())) / (1 + found)) + 1
    return _index(sample.mapInPandas(counted, _COUNTED), vocabulary, idf[: len(vocabulary)], sizes, np.maximum(idf[len(vocabulary) :], 0).astype(np.float32))


def judged(text: Column, index: Index) -> Column:
    """struct(score, predicted, evidence) of each whole text.

    A null or blank text, and one without a term of any example, has no neighbours: its score is the share of
    label 1 among examples of that sort. Repeated texts are judged alike; examples as near as the last neighbour all
    vote. Without labels every score is 0.
    """

    shared = SparkSession.active().sparkContext.broadcast(index)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader, known = _Reader(shared.value), {}
        for b in batches:
            new = [t for t in dict.fromkeys(b) if t not in known]
            if len(known) > MOST_JUDGED:
                known, new = {}, list(dict.fromkeys(b))
            known |= dict(zip(new, shared.value.scores(new, reader), strict=True))
            made = [known[t] for t in b]
            yield pd.DataFrame({"score": [m[0] for m in made], "predicted": [m[1] for m in made], "evidence": [m[2] for m in made]})

    return run(text)
