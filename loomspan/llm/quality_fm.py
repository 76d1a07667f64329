"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

Structure statistics and metadata (lengths) are cut at quantiles of the sample into bins, each a feature of its own; words are hashed, and
their weights are scaled to one length. The pairwise interactions of n features by vectors of rank k cost n k steps, by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Labels of the held-out fold, lang, source and doc_id are no inputs of a score. The fit uses at most learning.SAMPLE rows.

Defined results: a null text is empty and gets a score like any other; repeated rows get a row each; without labels every score is 0.5;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket
from .learning import SAMPLE, Hasher, sampled, words_of

BITS, RANK, BINS = 13, 6, 10
STATISTICS = ("chars", "words", "word_length", "distinct", "upper", "digits", "symbols", "marks", "exclamations", "lines", "line_words", "equal_lines", "bars", "others")
FOLDS, THRESHOLD = 5, 0.3
_DROP = {k: str.maketrans("", "", v) for k, v in {"digits": "0123456789", "symbols": "#*$%&<>@~^", "marks": ".,;:?", "exclamations": "!", "bars": "|"}.items()}


def statistics(text: str, words: list[str], distinct: int) -> list[float]:
    n, m = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    share = {k: (len(text) - len(text.translate(v))) / n for k, v in _DROP.items()}
    upper = sum(map(str.isupper, words)) / m
    letters = sum(map(len, words))
    return [np.log1p(len(text)), np.log1p(len(words)), letters / m, distinct / m, upper, share["digits"], share["symbols"], share["marks"], share["exclamations"], len(lines) / m, m / len(lines), 1 - len(set(lines)) / len(lines), share["bars"], 1 - letters / n]


def _features(texts: list[str], hasher: Hasher) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Statistics, and each text's hashed words with weights (logarithms of counts, scaled to length one)."""
    stats, places, weights = [], [], []
    for text in texts:
        words = words_of(text)
        own = np.array([hasher[w] for w in words], np.int64)
        place, count = np.unique(own, return_counts=True)
        stats.append(statistics(text, words, len(place)))
        weight = 1 + np.log(count)
        places.append(place)
        weights.append((weight / max(1e-9, float(np.sqrt((weight**2).sum())))).astype(np.float32))
    return np.array(stats, np.float64).reshape(-1, len(STATISTICS)), places, weights


class Machine:
    def __init__(self, edges: np.ndarray, seed: int = 5) -> None:
        self.edges = edges  # by statistic, the inner borders of its bins
        n = (1 << BITS) + len(STATISTICS) * BINS
        self.bias, self.weight = 0.0, np.zeros(n, np.float32)
        self.vector = np.random.default_rng(seed).normal(0, 0.05, (n, RANK)).astype(np.float32)

    def rows(self, stats: np.ndarray, places: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each row begins, and the places and values of its features."""
        bins = np.stack([np.searchsorted(e, stats[:, k], "right") for k, e in enumerate(self.edges)], 1) if len(stats) else np.zeros((0, len(STATISTICS)), np.int64)
        bins = bins + np.arange(len(STATISTICS)) * BINS + (1 << BITS)
        at, value, begin = [], [], [0]
        ones = np.full(len(STATISTICS), 1.0, np.float32)
        for b, p, w in zip(bins, places, weights, strict=True):
            at += [b, p]
            value += [ones, w]
            begin.append(begin[-1] + len(b) + len(p))
        return np.array(begin), np.concatenate([np.empty(0, np.int64), *at]), np.concatenate([np.empty(0, np.float32), *value])

    def score(self, begin: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The margins, and the rows' sums of vectors."""
        if len(begin) < 2:
            return np.empty(0), np.empty((0, RANK))
        own = self.vector[at] * value[:, None]
        sums, squares = (np.add.reduceat(x, begin[:-1], axis=0) for x in (own, own**2))
        return self.bias + np.add.reduceat(self.weight[at] * value, begin[:-1]) + 0.5 * (sums**2 - squares).sum(1), sums

    def fit(self, begin: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, *, epochs: int = 8, batch: int = 128, rate: float = 0.15, decay: float = 1e-4, seed: int = 3) -> None:
        """Adagrad on the logistic loss."""
        rng, n = np.random.default_rng(seed), len(y)
        seen_w, seen_v, seen_b = np.full(len(self.weight), 1e-2, np.float32), np.full(self.vector.shape, 1e-2, np.float32), 1e-2
        p = min(max(float(y.mean()), 0.01), 0.99)
        self.bias = float(np.log(p / (1 - p)))
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                rows = order[lo : lo + batch]
                size = begin[rows + 1] - begin[rows]
                own = np.repeat(begin[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                a, v, starts = at[own], value[own], np.concatenate(([0], np.cumsum(size)))
                margin, sums = self.score(starts, a, v)
                error = (1 / (1 + np.exp(-margin)) - y[rows]).astype(np.float32)
                e = np.repeat(error, size) * v
                touched, inverse = np.unique(a, return_inverse=True)
                g = np.bincount(inverse, e, len(touched)).astype(np.float32) / len(rows) + decay * self.weight[touched]
                seen_w[touched] += g**2
                self.weight[touched] -= rate * g / np.sqrt(seen_w[touched])
                gv = np.repeat(sums.astype(np.float32), size, axis=0) - self.vector[a] * v[:, None]
                gv *= e[:, None]
                g = np.stack([np.bincount(inverse, gv[:, k], len(touched)) for k in range(RANK)], 1).astype(np.float32) / len(rows) + decay * self.vector[touched]
                seen_v[touched] += g**2
                self.vector[touched] -= 0.3 * rate * g / np.sqrt(seen_v[touched])
                gb = float(error.mean())
                seen_b += gb**2
                self.bias -= rate * gb / np.sqrt(seen_b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(BITS)
    for batch in batches:
        stats, places, weights = _features(batch.column("text").to_pylist(), hasher)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array([x.astype(k).tobytes() for x in xs], pa.binary()) for xs, k in ((stats, np.float64), (places, np.int32), (weights, np.float32)))], ["doc_id", "label", "stats", "places", "weights"])


def train(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, sample: int = SAMPLE) -> Machine | None:
    """Fitted on labels.quality of documents whose crc32(doc_id as text) mod folds isn't 0; None without labels."""
    rows = sampled(docs, labels, "quality", crc_bucket("doc_id", folds) != 0, sample)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    kind = rows.schema["label"].dataType.simpleString()
    got = rows.select("doc_id", "label", "text").mapInArrow(_extract, f"doc_id {doc_id}, label {kind}, stats binary, places binary, weights binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id, bytes(r.places)))
    stats = np.array([np.frombuffer(r.stats, np.float64) for r in got])
    machine = Machine(np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T)
    begin, at, value = machine.rows(stats, [np.frombuffer(r.places, np.int32).astype(np.int64) for r in got], [np.frombuffer(r.weights, np.float32) for r in got])
    machine.fit(begin, at, value, np.array([float(r.label) for r in got]))
    return machine


def _score(sent: Any) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, hasher = sent.value, Hasher(BITS)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                if machine is None:
                    score = np.full(batch.num_rows, 0.5)
                else:
                    margin, _ = machine.score(*machine.rows(*_features(batch.column("text").to_pylist(), hasher)))
                    score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score.astype(np.float64))], ["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted (1 if score >= threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, sample=sample))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_bucket("doc_id", folds) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_score(sent), f"doc_id {doc_id}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
