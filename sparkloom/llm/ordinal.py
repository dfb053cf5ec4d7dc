"""Quality classifier: ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.blocks import chunks, give_back, pack, unpack, word_spans
from sparkloom.llm.common import fresh, released

BITS = 20
#: Bytes of text at a time: the arrays of a chunk take some seventy times its size.
CHUNK = 500_000
#: Lengths in bytes of the word beginnings that are features beside the words.
STEMS = (4, 5)
#: Surface measures enter as one of so many bins each.
BINS = 12
#: Labelled rows that the model is fitted on: those with the least hashes of their ids.
MAX_TRAINING_ROWS = 12_000
#: Of these, rows are taken in that order while their texts together have at most so many bytes (the first always is).
MAX_TRAINING_BYTES = 64_000_000

_BYTE = np.arange(256)
_LOWER, _UPPER = (_BYTE >= 97) & (_BYTE <= 122), (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT, _WIDE = (_BYTE >= 48) & (_BYTE <= 57), _BYTE >= 128
_BETWEEN = ~(_LOWER | _UPPER | _DIGIT | _WIDE)
_MARK = _BETWEEN & (_BYTE > 32)
_FOLD = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text (flat), and the bounds of the texts.

    Words, lower-cased over A-Z, the first 4 and 5 bytes of longer words (inflected forms share them), and the bins of ten surface measures share one space of 2 ** BITS indexes.
    """
    flat, sizes = [], []
    for a, b in chunks(texts, CHUNK):
        data = np.frombuffer(b" ".join(texts[a:b]) + b" ", dtype=np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[a:b])])[:-1]
        first, last, h, *stems = word_spans(_FOLD[data], _BETWEEN, STEMS)
        doc = np.searchsorted(starts, first, side="right") - 1
        m = b - a
        total = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)
        mark, lines = _MARK[data], data == 10
        twice = np.r_[mark[:-1] & mark[1:], False]
        letters = np.maximum(1, total(_LOWER[data] | _UPPER[data] | _WIDE[data]))
        length = np.maximum(1, np.diff(np.r_[starts, len(data)]) - 1)
        words = np.bincount(doc, minlength=m)
        again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=m)
        hashed = [(doc, h), *((doc[s > 0], s[s > 0]) for s in stems)]
        keys = np.unique(np.concatenate([d.astype(np.int64) << BITS | (x >> np.uint64(64 - BITS)).astype(np.int64) for d, x in hashed]))
        some = np.maximum(1, words)
        of_doc = keys >> BITS
        kinds = np.bincount(np.unique(doc.astype(np.int64) << 40 | (h >> np.uint64(24)).astype(np.int64)) >> 40, minlength=m)
        measures = [
            total(_UPPER[data]) / letters, total(_DIGIT[data]) / length, total(mark) / length, total(twice) / length,
            total(data == 124) / some, total(lines) / some, again / some, kinds / some,
            np.bincount(doc, weights=last - first, minlength=m) / some / 30, np.log2(words + 1) / 16,
        ]
        binned = [np.minimum(BINS - 1, (np.sqrt(np.clip(v, 0, 1)) * BINS).astype(np.int64)) for v in measures]
        extra = np.stack([(1 << BITS) + k * BINS + v for k, v in enumerate(binned)], axis=1)
        doc_of = np.r_[of_doc, np.repeat(np.arange(m), extra.shape[1])]
        index = np.r_[keys & ((1 << BITS) - 1), extra.ravel()]
        order = np.argsort(doc_of, kind="stable")
        flat.append(index[order])
        sizes.append(np.bincount(doc_of, minlength=m))
    if not flat:
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    return np.concatenate(flat), np.r_[0, np.cumsum(np.concatenate(sizes))]


WIDTH = (1 << BITS) + 10 * BINS


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . features); the weights are shared by all thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return at, self.weights[at], self.thresholds

    def __setstate__(self, state):
        at, values, self.thresholds = state
        self.weights = np.zeros(WIDTH)
        self.weights[at] = values

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the top grade, by row."""
        return 1 - _sigmoid(self.thresholds[None, :] - score[:, None])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        flat, bounds = features(texts)
        return np.add.reduceat(self.weights[flat], bounds[:-1]) if len(texts) else np.zeros(0)


def slopes(score: float, cut: np.ndarray, grade: int) -> tuple[float, np.ndarray]:
    """Derivatives of -log P(grade) by the score and by each threshold."""
    by_cut = np.zeros(len(cut))
    upper = _sigmoid(cut[grade] - score) if grade < len(cut) else 1.0
    lower = _sigmoid(cut[grade - 1] - score) if grade > 0 else 0.0
    p = max(upper - lower, 1e-9)
    du, dl = upper * (1 - upper), lower * (1 - lower)
    if grade < len(cut):
        by_cut[grade] = -du / p
    if grade > 0:
        by_cut[grade - 1] = dl / p
    return (du - dl) / p, by_cut


def thresholds_of(first: float, log_gaps: np.ndarray) -> np.ndarray:
    """Thresholds from the lowest one and the logarithms of the gaps above it: whatever these are, they are in order."""
    return first + np.r_[0.0, np.cumsum(np.exp(log_gaps))]


def fit(flat: np.ndarray, bounds: np.ndarray, grades: np.ndarray, top: int, *, epochs: int = 5, rate: float = 0.4, l1: float = 0.23, seed: int = 7) -> OrdinalModel:
    """Fits by likelihood, row after row with a rate per weight; l1 (times the root of the number of rows) keeps
    the weights of chance words at zero.

    Thresholds start at the grades' shares. What is fitted is the lowest one and the logarithm of each gap, so
    that they stay in order and apart.
    """
    n = len(grades)
    l1 = l1 * np.sqrt(n)
    share = (np.bincount(grades, minlength=top + 1) + 0.5) / (n + 0.5 * (top + 1))
    below = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    first, log_gaps = start[0], np.log(np.maximum(np.diff(start), 1e-3))
    cut = thresholds_of(first, log_gaps)
    z, square = np.zeros(WIDTH), np.zeros(WIDTH)
    w = np.zeros(WIDTH)
    rng = np.random.default_rng(seed)
    steps = 0
    for _ in range(epochs):
        for i in rng.permutation(n):
            at, y = flat[bounds[i] : bounds[i + 1]].astype(np.int64), grades[i]
            zi = z[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1 + np.sqrt(square[at])) / rate + 0.01))
            w[at] = wi
            g, by_cut = slopes(wi.sum(), cut, y)
            grown = square[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(square[at])) / rate * wi
            square[at] = grown
            steps += 1
            step = 0.5 / np.sqrt(steps + 10)
            by_cut = np.clip(by_cut, -5.0, 5.0)
            first -= step * by_cut.sum()
            if top > 1:  # a gap moves every threshold above it
                above = np.cumsum(by_cut[::-1])[::-1][1:]
                log_gaps = np.clip(log_gaps - step * np.exp(log_gaps) * above, -7.0, 7.0)
            cut = thresholds_of(first, log_gaps)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(square)) / rate + 0.01))
    return OrdinalModel(w, cut)


def graded(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, grade): 0 poor, 1 well written but toxic, 2 good. The least of a document's ratings counts."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") >= 1, 1).when(F.col("quality") >= 1, 2)
    rated = labels.select(F.col(id_col).cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    return rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", top: int = 2, max_rows: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES, **options) -> OrdinalModel | None:
    """Fits on at most `max_rows` graded documents of at most `max_bytes` of text, picked by a hash of the id; None without any.

    Features are made on the executors, and one task, whose input `max_rows` and `max_bytes` bound, fits the model. The
    driver gets the weights that aren't zero, and of each picked row its id, size and place.
    """
    picked = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    sizes = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.xxhash64("doc_id").alias("at")).toPandas()
    sizes = sizes.sort_values(["at", "doc_id"], ignore_index=True)
    if len(sizes) and sizes["bytes"].sum() > max_bytes:
        upto = max(1, int((sizes["bytes"].cumsum() <= max_bytes).sum()))
        picked = picked.join(F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in sizes["doc_id"][:upto]], "doc_id long")), "doc_id")

    def encode(batches):
        for pdf in batches:
            flat, bounds = features(pdf["text"].tolist())
            index = [flat[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "index": index})

    def fitted(batches):
        if frames := [pdf for pdf in batches if len(pdf)]:
            found = pd.concat(frames).sort_values(["doc_id", "index"], ignore_index=True)
            frames.clear()
            parts = [np.frombuffer(x, "<i4") for x in found["index"]]
            model = fit(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), found["grade"].to_numpy(), top, **options)
            yield pd.DataFrame({"model": [pack(model)]})
            del found, parts, model
            give_back()

    found = rows.join(F.broadcast(picked), "doc_id").mapInPandas(encode, "doc_id long, grade int, index binary")
    made = released(found.repartition(1).mapInPandas(fitted, "model binary")).collect()
    return unpack(made[0]["model"])[0] if made else None


def _probabilities(model: OrdinalModel | None, text: Column) -> Column:
    @F.pandas_udf("struct<expected_grade double, p_tail double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame({"expected_grade": np.full(len(texts), np.nan), "p_tail": np.ones(len(texts))})
        tails = model.tails(model.scores(texts.tolist()))
        give_back()
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_tail": tails[:, -1]})

    return score(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def classify(docs: DataFrame, model: OrdinalModel | None, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """Per document: doc_id, expected_grade, p_tail (probability of the top grade), keep (p_tail >= least).

    Null text is empty and gets what the model says of an empty text. Without labelled rows there is no model:
    everything is kept, with p_tail 1 and a NaN grade. One row out per row in; other columns are ignored.
    """
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), _probabilities(model, F.col(text_col)).alias("p"))
    return out.select("doc_id", "p.expected_grade", "p.p_tail", (F.col("p.p_tail") >= least).alias("keep"))


def keep_good(docs: DataFrame, model: OrdinalModel | None, *, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of `docs` whose text the model accepts, with their columns, which may have any name."""
    (name,) = fresh(docs, "p_tail")
    return docs.withColumn(name, _probabilities(model, F.col(text_col))["p_tail"]).where(F.col(name) >= least).drop(name)
