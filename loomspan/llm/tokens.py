"""Ids of a byte-level BPE vocabulary, as the tokenizers library gives them, at the speed of a dictionary.

The library cuts a text into pre-tokens by a fixed pattern and merges within each alone. So a text's ids are those of its
pre-tokens, one after another; the library encodes each distinct pre-token once per worker, and texts are then joined from
stored bytes (ids as little-endian unsigned 32-bit integers). Texts with added tokens' strings, or characters outside the
ranges whose classes all Unicode versions agree on, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

_RANGES = "\t-\n\r\x20-\x7e\xa1-\xac\xae-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԓぁ-ゖァ-ヺ一-龥"
_OTHER = re.compile(f"[^{_RANGES}]")
#: Distinct pre-tokens kept by a worker, and the characters of the longest that is kept.
KEEP, KEEP_CHARS = 250_000, 64


def _class(letter: str) -> str:
    """The characters of a general category within _RANGES, as ranges of a pattern."""
    points = [x for x in range(0xA000) if unicodedata.category(chr(x))[0] == letter and not _OTHER.match(chr(x))]
    out, i = "", 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out += re.escape(chr(points[i])) + ("-" + re.escape(chr(points[j])) if j > i else "")
        i = j + 1
    return out


class ByteBpe:
    """Encodes batches of texts, without special tokens added, to packed ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to give
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        known = spec.get("normalizer") is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["model"]["type"] == "BPE"
        self.added = [x["content"] for x in spec["added_tokens"]]
        letters, numbers, space = _class("L"), _class("N"), "\t\n\r "
        # The pre-tokeniser's pattern.
        self.cut = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.whole = _OTHER.search if known else lambda text: True
        self.kept: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for x, i in vocabulary.items() if x[:1] == "Ġ"]] = True  # tokens that begin with a space

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each pre-token. Those of a space and more are encoded as one text, whose ids are cut where a token
        begins with a space."""
        spaced = [w for w in words if w[0] == " " and not w[1:2].isspace() and len(w) > 1]
        out: dict[str, bytes] = {}
        for lo in range(0, len(spaced), 1024):
            own = spaced[lo : lo + 1024]
            found = np.array(self.library.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, "<u4")
            edges = np.append(np.flatnonzero(self.spaced[found]), len(found))
            if len(edges) == len(own) + 1:
                ids, edges = found.tobytes(), 4 * edges
                out.update((w, ids[a:b]) for w, a, b in zip(own, edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._encode(rest), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(texts), 1024):
            out += self._encode_some([x or "" for x in texts[lo : lo + 1024]])
        return out

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        kept, met = self.kept, set()
        cut = [None if self.whole(x) or any(y in x for y in self.added) else self.cut(x) for x in texts]
        met.update(*filter(None, cut))
        missing = list(met.difference(kept))
        if missing:
            full = len(kept) >= KEEP  # the first to come are the most frequent; once full, it stays as it is
            kept.update(self._encode_words(missing))
        out = [self._encode([x])[0] if words is None else b"".join(map(kept.__getitem__, words)) for x, words in zip(texts, cut, strict=True)]
        for word in missing:
            if full or len(word) > KEEP_CHARS:
                del kept[word]
        return out


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process and vocabulary file."""
    return ByteBpe(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
