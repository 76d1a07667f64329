"""A bounded, documented sample of labelled documents for the classifiers' fits."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The documented bound: so many labelled documents at most are learned from, those with the least hash of their doc_id.
SAMPLE = 8000

words_of = re.compile(r"\w+").findall


class Hasher(dict):
    """A word's place among 2 ** bits, remembered for words met before."""

    def __init__(self, bits: int, keep: int = 300_000) -> None:
        super().__init__()
        self.mask, self.keep = (1 << bits) - 1, keep

    def __missing__(self, word: str) -> int:
        place = zlib.crc32(word.encode()) & self.mask
        if len(self) < self.keep:
            self[word] = place
        return place


def sampled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and label (0 or 1) of labelled rows for which learn holds. Rows of one doc_id count with its largest label."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
