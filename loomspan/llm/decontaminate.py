"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of normalised benchmark items.

Words are runs of ASCII letters, digits and any non-ASCII characters, after A-Z are lower-cased. A window is `width`
consecutive words of an item; an item of fewer words, but not none, is one window. The automaton's letters are word numbers,
so a text is scanned once, in time linear in its words, and a match is a range of words that maps to places in the
original text.

The items are a stated query set. An automaton takes about 105 bytes of a worker's memory for a byte of items (measured), so one holds at most
`block_bytes` of them (or one item); items beyond go to further automata, each broadcast. A text passes through BLOCKS_A_PASS automata in
one scan without a shuffle; then what was found is written down, so that a worker holds no more of them.

Defined results: a null or empty text has no words; a null or wordless item has no windows; repeated items with one id count
as one item, items with equal texts count each; repeated documents get a row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each, materialize, texts

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_HITS = "array<struct<first:int,last:int,item:string>>"
#: So many automata a scan.
BLOCKS_A_PASS = 2
BLOCK_BYTES = 2 << 20


def windows(text: bytes, width: int) -> list[tuple[bytes, ...]]:
    words = WORD.findall(text.lower())
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def build(items: list[tuple[str, bytes]], width: int) -> tuple[Any, dict[bytes, int], list[tuple[int, list[str]]]]:
    """The automaton, each word's number (from 1; other words are 0), and per pattern its length and its items."""
    vocabulary: dict[bytes, int] = {}
    place: dict[tuple[int, ...], int] = {}
    owners: list[tuple[int, list[str]]] = []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for item, text in items:
        for window in windows(text, width):
            key = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in window)
            if key not in place:
                place[key] = len(owners)
                owners.append((len(key), []))
                automaton.add_word(key, place[key])
            if item not in owners[place[key]][1]:
                owners[place[key]][1].append(item)
    if owners:
        automaton.make_automaton()
    return automaton, vocabulary, owners


@lru_cache(maxsize=BLOCKS_A_PASS)
def _built(block: Any, width: int) -> tuple[Any, dict[bytes, int], list[tuple[int, list[str]]]]:
    return build(block.value, width)


class _Block:
    """A broadcast block, hashable by its number, so that a Python worker builds each automaton once."""

    def __init__(self, broadcast: Any) -> None:
        self.broadcast, self.number = broadcast, int(broadcast._jbroadcast.id())

    def __hash__(self) -> int:
        return hash(self.number)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Block) and other.number == self.number

    @property
    def value(self) -> list[tuple[str, bytes]]:
        return self.broadcast.value


def _scan(block: _Block, width: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, vocabulary, owners = _built(block, width)
        known = vocabulary.get
        for batch in batches:
            hits, n_words = [], []
            for text, found in zip(texts(batch), each(batch.column("hits")), strict=True):
                found = found or []
                numbers = tuple([known(w, 0) for w in WORD.findall(text.lower())]) if text else ()
                n_words.append(len(numbers))
                if owners and numbers:
                    for last, pattern in automaton.iter(numbers):
                        length, items = owners[pattern]
                        found += [{"first": last - length + 1, "last": last, "item": item} for item in items]
                hits.append(found)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hits, kind), pa.array(n_words, pa.int64())], ["doc_id", "text", "hits", "n_words"])

    return run


def _conclude(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        n_hit, items, spans = [], [], []
        for text, hits in zip(texts(batch), each(batch.column("hits")), strict=True):
            if not hits:
                n_hit.append(0)
                items.append([])
                spans.append([])
                continue
            places = [m.span() for m in WORD.finditer(text.lower())]
            mark = bytearray(len(places))
            for h in hits:
                mark[h["first"] : h["last"] + 1] = b"\1" * (h["last"] + 1 - h["first"])
            n_hit.append(sum(mark))
            items.append(sorted({h["item"] for h in hits}))
            own, points, done = [], 0, 0
            for run in re.finditer(rb"\x01+", mark):
                a, b = places[run.start()][0], places[run.end() - 1][1]
                points += len(text[done:a].decode())
                own.append({"start": points, "end": (points := points + len(text[a:b].decode()))})
                done = b
            spans.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)],
            ["doc_id", "n_words", "n_hit", "items", "spans"],
        )


def _blocks(spark: SparkSession, items: DataFrame, block_bytes: int) -> list[tuple[int, _Block]]:
    """The items as broadcasts of about block_bytes of text at most."""
    asked = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if total <= block_bytes else 2 * (total // block_bytes + 1)
    out = []
    for k in range(n):
        own = asked if n == 1 else asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        out.append((k, _Block(spark.sparkContext.broadcast([(r.item, bytes(r.text)) for r in own.collect()]))))
    return out


def _clean(block: _Block, width: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, vocabulary, owners = _built(block, width)
        known = vocabulary.get
        for batch in batches:
            stays = []
            for text in texts(batch):
                numbers = tuple([known(w, 0) for w in WORD.findall(text.lower())]) if text and owners else ()
                stays.append(not numbers or next(iter(automaton.iter(numbers)), None) is None)
            yield batch.filter(pa.array(stays, pa.bool_()))

    return run


def scan(docs: DataFrame, items: DataFrame, *, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, items (ids with occurring windows, sorted as strings) and spans
    (hit runs as code points of the original text, end exclusive). items: item_id, text."""
    spark = docs.sparkSession
    blocks = _blocks(spark, items, block_bytes)
    at = docs.select("doc_id", "text", F.lit(None).cast(_HITS).alias("hits"), F.lit(None).cast("long").alias("n_words"))
    schema = at.schema
    for k, block in blocks:
        step = _scan(block, width)
        if k == len(blocks) - 1:
            doc_id = docs.schema["doc_id"].dataType.simpleString()
            return at.mapInArrow(lambda batches, step=step: _conclude(step(batches)), f"doc_id {doc_id}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")
        at = at.mapInArrow(step, schema)
        if k % BLOCKS_A_PASS == BLOCKS_A_PASS - 1:
            at = materialize(at, f"scanned{k}", "zstd")
    raise AssertionError("there is at least one block")


def report(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """scan(), with the digest of the items instead of the lists."""
    return scan(docs, items, **options).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("hit_spans"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, *, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without an occurring window, with all their columns; a text is scanned where it is, without a shuffle."""
    spark = docs.sparkSession
    blocks = _blocks(spark, items, block_bytes)
    for k, block in blocks:
        docs = docs.mapInArrow(_clean(block, width), docs.schema)
        if k % BLOCKS_A_PASS == BLOCKS_A_PASS - 1 and k < len(blocks) - 1:
            docs = materialize(docs, f"clean{k}", "zstd")
    return docs
