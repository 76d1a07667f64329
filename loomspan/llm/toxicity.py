"""Toxicity by multiple-instance learning: a document is a bag of sentences, and is toxic if one of them is.

A sentence's probability is logistic in its hashed words and their beginnings, each as often as it occurs; a document's is their noisy-or,
1 - prod(1 - p). Labels are known of documents only: the gradient of the document's loss reaches its sentences through the noisy-or, so
that training finds which of them are to blame.

Only features that tell toxic documents apart have a weight: those that more of the toxic than of the other documents of the sample have,
by a log-likelihood ratio (G squared) of `evidence` or more. They are counted by the executors, so that the driver gets no others; a
sentence without any is a number in the count of its document's plain sentences.

Labels of the held-out fold, lang, source and doc_id are no inputs of a score. The fit uses at most SAMPLE rows.

Defined results: a null or blank text has no sentence and score 0; repeated rows get a row each; without labels every score is 0.5;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, each, materialize
from .learning import SAMPLE, sampled, words_of

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
FOLDS, HELD, THRESHOLD = 4, 2, 0.3
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w")


class Stems(dict):
    """The places of a word and of its beginnings, remembered for words met before: a stem offends whatever its ending. With telling, only
    places among these."""

    def __init__(self, telling: Iterable[int] | None = None, keep: int = 150_000) -> None:
        super().__init__()
        self.telling, self.keep = None if telling is None else frozenset(telling), keep

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = {f"{word}$", *(word[:k] for k in PREFIXES if len(word) >= k)}
        places = {zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in parts}
        own = tuple(sorted(places if self.telling is None else places & self.telling))
        if len(self) < self.keep:
            self[word] = own
        return own


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(text, *m.span())]


def bag(text: str, hasher: Stems) -> tuple[list[int], list[int], list[tuple[int, int]], int]:
    """Of the sentences with features: the features behind each other, how many each has, where it is; and how many sentences have none."""
    places: list[int] = []
    sizes, spans, plain = [], [], 0
    for a, b in sentences(text):
        before = len(places)
        for word in words_of(text[a:b].lower()):
            places += hasher[word]
        if len(places) > before:
            sizes.append(len(places) - before)
            spans.append((a, b))
        else:
            plain += 1
    return places, sizes, spans, plain


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, which may be empty."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class NoisyOr:
    """Bags are given by places (of all features), sizes (features by sentence), counts (such sentences by bag) and plain (others by bag)."""

    def __init__(self) -> None:
        self.bias, self.weight = -5.0, np.zeros(1 << BITS, np.float64)

    def instances(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.clip(self.bias + _sums(self.weight[places], sizes), -30, 30)

    def refusals(self, z: np.ndarray, counts: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """-log(1 - P) of each bag."""
        return _sums(np.logaddexp(0, z), counts) + plain * np.logaddexp(0, self.bias)

    def score(self, z: np.ndarray, counts: np.ndarray, plain: np.ndarray) -> np.ndarray:
        return -np.expm1(-self.refusals(z, counts, plain))

    def gradient(self, places: np.ndarray, sizes: np.ndarray, counts: np.ndarray, plain: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        """The mean logarithmic loss, the places that occur, the loss's derivatives by their weights, and by the bias."""
        z = self.instances(places, sizes)
        total = self.refusals(z, counts, plain)
        # Of a toxic bag -log(1 - exp(-total)), of another total.
        push = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0) / len(y)
        loss = float(np.where(y > 0, -np.log(np.maximum(-np.expm1(-total), 1e-12)), total).mean())
        g = np.repeat(push, counts) / (1 + np.exp(-z))
        touched, inverse = np.unique(places, return_inverse=True)
        return loss, touched, np.bincount(inverse, np.repeat(g, sizes), len(touched)), float(g.sum() + (push * plain).sum() / (1 + np.exp(-self.bias)))

    def fit(self, places: np.ndarray, sizes: np.ndarray, counts: np.ndarray, plain: np.ndarray, y: np.ndarray, *, epochs: int = 240, batch: int = 256, rate: float = 0.4, decay: float = 1e-4, seed: int = 11) -> None:
        """Adagrad on the documents' logarithmic loss."""
        word_begin, text_begin = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        seen, seen_b, rng = np.full(1 << BITS, 1e-3), 1e-3, np.random.default_rng(seed)

        def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            many = end - begin
            return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())

        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                rows = order[lo : lo + batch]
                own = ranges(text_begin[rows], text_begin[rows + 1])
                words = ranges(word_begin[text_begin[rows]], word_begin[text_begin[rows + 1]])
                _, touched, gw, gb = self.gradient(places[words], sizes[own], counts[rows], plain[rows], y[rows])
                gw = gw + decay * self.weight[touched]
                seen[touched] += gw**2
                self.weight[touched] -= rate * gw / np.sqrt(seen[touched])
                seen_b += gb**2
                self.bias -= 0.1 * rate * gb / np.sqrt(seen_b)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts, and in how many toxic ones, each place occurs; a row for each place of the task's texts."""
    hasher, texts = Stems(), np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, label in zip(each(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            own = np.array(sorted({x for w in words_of(text.lower()) for x in hasher[w]}), np.int64)
            texts[0, own] += 1
            texts[1, own] += int(label > 0)
    met = np.flatnonzero(texts[0])
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(texts[0, met]), pa.array(texts[1, met])], ["place", "n", "toxic"])


def evidence_of(n: Column, toxic: Column, rows: int, positive: int) -> Column:
    """G squared of a feature that n of the rows and toxic of the positive ones have."""

    def f(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    a, b = toxic.cast("double"), (n - toxic).cast("double")
    c, d = positive - a, (rows - positive) - b
    whole = float(rows * np.log(rows) - sum(x * np.log(x) for x in (positive, rows - positive) if x))
    return 2 * (f(a) + f(b) + f(c) + f(d) - f(a + b) - f(c + d) + whole)


def _extract(telling: list[int]) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Stems(telling)
        for batch in batches:
            rows: list[list[Any]] = [[], [], []]
            for text in each(batch.column("text")):
                places, sizes, _, plain = bag(text, hasher)
                rows[0].append(np.array(places, np.int32).tobytes())
                rows[1].append(np.array(sizes, np.int32).tobytes())
                rows[2].append(plain)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array(x, t) for x, t in zip(rows, (pa.binary(), pa.binary(), pa.int64()), strict=True))], ["doc_id", "label", "places", "sizes", "plain"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE, evidence: float = 16.0) -> tuple[list[int], NoisyOr] | None:
    """The places that tell, and a fit on labels.toxic of documents whose crc32(doc_id as text) mod folds isn't held; None without labels."""
    rows = materialize(sampled(docs, labels, "toxic", crc_bucket("doc_id", folds) != held, sample), "sample", "zstd")
    many, positive = rows.agg(F.count("*"), F.count_if(F.col("label") > 0)).first()
    if not many:
        return None
    met = rows.select("label", "text").mapInArrow(_occurrences, "place long, n long, toxic long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    n, toxic = F.col("n"), F.col("toxic")
    telling = sorted(r.place for r in met.where((toxic * many > n * positive) & (evidence_of(n, toxic, many, positive) >= evidence)).select("place").collect())
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    kind = rows.schema["label"].dataType.simpleString()
    got = rows.select("doc_id", "label", "text").mapInArrow(_extract(telling), f"doc_id {doc_id}, label {kind}, places binary, sizes binary, plain long").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.places)))
    places, sizes = (np.frombuffer(b"".join(bytes(r[k]) for r in got), np.int32) for k in ("places", "sizes"))
    counts, plain = np.array([len(r.sizes) // 4 for r in got]), np.array([float(r.plain) for r in got])
    model = NoisyOr()
    model.fit(places, sizes, counts, plain, np.array([float(r.label) for r in got]))
    return telling, model


def _score(sent: Any, locate: float) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling, model = sent.value or ([], None)
        hasher = Stems(telling)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for text in each(batch.column("text")):
                if model is None:
                    scores.append(0.5)
                    found.append([])
                    continue
                places, sizes, spans, plain = bag(text, hasher)
                z = model.instances(np.array(places, np.int64), np.array(sizes, np.int64))
                scores.append(float(model.score(z, np.array([len(z)]), np.array([plain]))[0]))
                p = 1 / (1 + np.exp(-z))
                found.append([{"start": spans[k][0], "end": spans[k][1], "score": float(p[k])} for k in np.flatnonzero(p >= locate)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.clip(np.array(scores, float), 0, 1)), pa.array(found, kind)], ["doc_id", "held_out", "score", "sentences"])

    return run


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held: int = HELD, threshold: float = THRESHOLD, locate: float = 0.1, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted (1 if score >= threshold), sentences (code points, end
    exclusive) whose own probability is locate or more."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, held=held, sample=sample))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_bucket("doc_id", folds) == held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(sent, locate), f"doc_id {doc_id}, held_out boolean, score double, sentences array<struct<start:long,end:long,score:double>>")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
