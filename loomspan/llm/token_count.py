"""Token counts by rank-synchronous array merging.

A byte-fallback BPE model without pre-tokenisation merges, again and again, the adjacent pair of symbols whose joined piece has
the best rank. No piece spans a space mark that follows another character, so a text is cut there into pre-tokens; distinct
pre-tokens of a batch lie behind each other in one ragged numpy array, cut further between characters that are
neighbours in no piece. Each round finds every sequence's lowest rank and merges all its places at once, until none is
left; then the surviving symbols are counted, a character without a piece as its bytes. A worker keeps the counts of
pre-tokens it has met.

Defined results: a null text is empty, with no tokens; repeated rows stay; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import default_path

SPACE = "▁"
KEEP, KEEP_CHARS = 250_000, 64
_NONE = np.iinfo(np.int64).max


class RankMerger:
    """Counts of a sentencepiece BPE model's tokens."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        t, n = model.trainer_spec, model.normalizer_spec
        plain = [(p.piece, p.score) for p in model.pieces if p.type == p.NORMAL]
        if t.model_type != t.BPE or not t.byte_fallback or n.name != "identity" or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or t.treat_whitespace_as_suffix or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces) or any(SPACE in p.lstrip(SPACE) for p, _ in plain):
            raise ValueError(f"{path}: only BPE models with byte fallback, identity normalisation and spaces in front are supported")
        number = {p: i for i, (p, _) in enumerate(plain)}
        self.size = len(plain) + 1  # the last stands for characters without a piece
        order = {s: r for r, s in enumerate(sorted({-s for _, s in plain}))}
        keys, ranks, into, near = [], [], [], set()
        for p, s in plain:
            for k in range(1, len(p)):
                near.add((ord(p[k - 1]) << 21) | ord(p[k]))
                if (a := number.get(p[:k])) is not None and (b := number.get(p[k:])) is not None:
                    keys.append(a * self.size + b)
                    ranks.append(order[-s])
                    into.append(number[p])
        sort = np.argsort(keys)
        self.keys, self.ranks, self.into = (np.array(x, np.int64)[sort] for x in (keys, ranks, into))
        self.near = np.array(sorted(near), np.int64)
        chars = sorted((ord(p), i) for p, i in number.items() if len(p) == 1)
        self.chars, self.char_piece = np.array([c for c, _ in chars], np.int64), np.array([i for _, i in chars], np.int64)
        joined = {c for p, _ in plain if len(p) > 1 for c in p}
        alone = re.escape("".join(c for c in map(chr, range(0x250)) if c not in joined and c != " "))
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|[{alone}]|{SPACE}+").findall
        self.kept: dict[str, int] = {}

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, a sequence of its own."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        length = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), length)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        known = self.chars[at] == points
        symbol = np.where(known, self.char_piece[at], self.size - 1)
        count = np.bincount(word[~known], weights=(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))[~known], minlength=len(words)).astype(np.int64)
        count -= np.bincount(word[~known], minlength=len(words))
        cut = np.ones(len(points), bool)  # a sequence begins here
        if len(points) > 1:
            pair = (points[:-1] << 21) | points[1:]
            place = np.minimum(np.searchsorted(self.near, pair), len(self.near) - 1)
            cut[1:] = (word[1:] != word[:-1]) | (self.near[place] != pair)
        while len(symbol):
            first = np.flatnonzero(cut)
            rank, new = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)
            inner = np.flatnonzero(~cut[1:])  # each with a neighbour on its right
            pair = symbol[inner] * self.size + symbol[inner + 1]
            place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            found = self.keys[place] == pair
            rank[inner[found]], new[inner[found]] = self.ranks[place[found]], self.into[place[found]]
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbol)))
            ended = least == _NONE
            if ended.any():  # these sequences are counted and leave
                gone = np.repeat(ended, sizes)
                count += np.bincount(word[gone], minlength=len(words))
                symbol, word, cut, rank, new = (x[~gone] for x in (symbol, word, cut, rank, new))
                least, sizes = least[~ended], sizes[~ended]
                if not len(symbol):
                    break
            hit = rank == np.repeat(least, sizes)
            places = np.flatnonzero(hit)
            # Of overlapping places (a run of one symbol), every second counts from the left.
            begins = np.append(True, np.diff(places) > 1)
            since = np.arange(len(places)) - np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
            places = places[since % 2 == 0]
            symbol[places] = new[places]
            stay = np.ones(len(symbol), bool)
            stay[places + 1] = False
            symbol, word, cut = symbol[stay], word[stay], cut[stay]
        return count

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        for lo in range(0, len(texts), 1024):
            out += self._count_some(texts[lo : lo + 1024])
        return out

    def _count_some(self, texts: list[str | None]) -> list[int]:
        kept, cut = self.kept, [self.cut(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        met: set[str] = set()
        met.update(*cut)
        missing = list(met.difference(kept))
        if missing:
            full = len(kept) >= KEEP  # the first to come are the most frequent; once full, it stays as it is
            kept.update(zip(missing, self.merge(missing).tolist(), strict=True))
        out = [sum(map(kept.__getitem__, words)) for words in cut]
        for word in missing:
            if full or len(word) > KEEP_CHARS:
                del kept[word]
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def _counts(model: str, limit: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(model)
        for batch in batches:
            text = batch.column("text")
            n = np.array(counter.count(text.to_pylist()), np.int64)
            n_bytes = [len(x) if x else 0 for x in text.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, *, model: str | None = None, limit: int = 4096) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_counts(model or default_path("piece_bpe_32k.model"), limit), f"doc_id {doc_id}, n_bytes long, n_tokens long, over_limit boolean")
