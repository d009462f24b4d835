"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained with FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 14
#: Labelled rows of each language that the model is fitted on, about, and of all languages together, which share these alike.
ROWS_PER_LANGUAGE, MOST_ROWS = 1500, 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
_letters: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    return _letters[points]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of the whole text and log-scaled counts; both empty if it has no letter.

    Letters are lower-cased; runs of anything else are one blank.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_is_letter(points), points, np.uint32(32))
    if not (points != 32).any():
        return np.empty(0, np.int64), np.empty(0, np.float32)
    points = np.concatenate(([32], points, [32]))
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))].astype(np.uint64)
    one, two = points, (points[:-1] << np.uint64(21)) | points[1:]
    three = (two[:-1] << np.uint64(21)) | points[2:]
    keys = np.concatenate((one, two, three)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
    counts = np.bincount(keys.astype(np.int64), minlength=1 << BITS)
    index = np.flatnonzero(counts)
    return index, np.log1p(counts[index]).astype(np.float32)


@dataclass
class Model:
    """Classes, idf of each hashed gram, weights by gram and class (last row: bias), and the calibrated temperature."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, index: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[index]
        return (x / max(float(np.sqrt(x @ x)), 1e-12)) @ self.weights[index] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        index, tf = grams(text)
        if not index.size or not self.classes:
            return "und", 0.0
        p = _softmax(self.logits(index, tf) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(examples: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """A model from (index, tf, language) examples in a fixed order; every fifth calibrates the temperature.

    Weights follow the regularised leader: each gram and class keeps z and n, and is zero while ``|z| <= L1``.
    """
    classes = sorted({lang for _, _, lang in examples})
    df = np.zeros(1 << BITS)
    for index, _, _ in examples:
        df[index] += 1
    idf = (np.log((1 + len(examples)) / (1 + df)) + 1).astype(np.float32)
    z, n = np.zeros((2, (1 << BITS) + 1, len(classes)))
    model = Model(classes, idf, np.zeros((0, 0)))

    def weights(rows: np.ndarray) -> np.ndarray:
        zr = z[rows]
        return np.where(np.abs(zr) <= L1, 0.0, -(zr - np.sign(zr) * L1) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2))

    order = np.random.default_rng(0).permutation(len(examples))
    for _ in range(EPOCHS):
        for k in order:
            if len(examples) >= 10 and k % 5 == 0:
                continue
            index, tf, lang = examples[k]
            x = tf * idf[index]
            x = np.append(x / max(float(np.sqrt(x @ x)), 1e-12), 1.0)
            rows = np.append(index, 1 << BITS)
            w = weights(rows)
            g = np.outer(x, _softmax(x @ w) - (np.arange(len(classes)) == classes.index(lang)))
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / ALPHA
            z[rows] += g - sigma * w
            n[rows] += g * g
    model.weights = weights(np.arange((1 << BITS) + 1)).astype(np.float32)
    held = [(model.logits(i, tf).astype(float), classes.index(lang)) for k, (i, tf, lang) in enumerate(examples) if k % 5 == 0 or len(examples) < 10]

    def loss(t: float) -> float:
        return -sum(np.log(max(_softmax(zs / t)[y], 1e-12)) for zs, y in held)

    if held:
        model.temperature = float(min(np.geomspace(0.02, 20, 61), key=loss))
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of every language in the labelled rows, fitted on a hash sample: about ROWS_PER_LANGUAGE rows of each,
    fewer where all of them would be more than MOST_ROWS.

    Only the sample's hashed grams reach the driver (at most ``2 ** BITS`` a row), about MOST_ROWS rows at most. Null
    texts and those without a letter teach nothing; repeated rows with the same id are drawn together.
    """
    labelled = docs.where(F.col(lang_col).isNotNull())
    sizes = labelled.groupBy(lang_col).count().collect()  # a row a language
    if not sizes:
        return Model([], np.zeros(1 << BITS, np.float32), np.zeros(((1 << BITS) + 1, 0), np.float32))
    wanted = min(ROWS_PER_LANGUAGE, MOST_ROWS / len(sizes))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[lang_col], min(1.0, wanted / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(1 << 30)) / (1 << 30)
    sample = labelled.where(draw < F.element_at(share, F.col(lang_col))).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [grams(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "lang": b["lang"], "index": [i for i, _ in made], "tf": [t for _, t in made]})

    rows = sample.mapInPandas(featured, "id string, lang string, index array<int>, tf array<float>").toPandas()
    rows = rows.assign(n=[len(x) for x in rows["index"]]).sort_values(["id", "lang", "n"], kind="stable", na_position="first")
    return fit([(np.asarray(i, np.int64), np.asarray(t, np.float32), lang) for i, t, lang in zip(rows["index"], rows["tf"], rows["lang"], strict=True) if len(i)])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, lang_pred, score (0 to 1: the calibrated probability).

    Null texts and texts without a letter get ``und`` and score 0, as do all texts when the model has no class. Whole
    texts are read; repeated rows are judged alike; no rows, no result; other columns are not read.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [model.predict(t) for t in b["__text"]]
            yield pd.DataFrame({"__id": b["__id"], "lang_pred": [x for x, _ in made], "score": [s for _, s in made]})

    plain = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"))
    made = plain.mapInPandas(run, "__id string, lang_pred string, score double")
    return made.select(F.col("__id").cast(kind).alias(id_col), "lang_pred", "score")
