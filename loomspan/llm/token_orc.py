"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by doc_id, so a file holds a range of ids and a stripe a range within it: a reader
of some ids skips files and stripes by their statistics and Bloom filters, and readers of everything take stripes in parallel.
A row holds doc_id, part (the file's place in the order), start_in_part (ids of the part before the document), n_tokens and ids. A
document's start over all files is start_in_part plus the totals of the parts before, of which there is one row a file.

Defined results: a null text is empty (only the end id); null ids come first; documents with one id are ordered by a hash of
their texts; repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path
from .tokens import byte_bpe, default_path

#: Fixed values of the file format: bytes of a stripe, rows of a row index entry, the Bloom filter's false positives.
ORC = {"orc.stripe.size": str(64 << 20), "orc.row.index.stride": "2000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
END = 2


def _encode(tokenizer: str, end_id: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                packed = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
                counts = np.array([len(x) // 4 for x in packed], np.int64)
                offsets = np.concatenate(([0], np.cumsum(counts)))
                ids = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(before + offsets[:-1]), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids)],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                before += int(offsets[-1])

    return run


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = END) -> None:
    """Encodes docs (doc_id, text), appends end_id to each, and writes them in ascending doc_id order."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    encoded = ordered.mapInArrow(_encode(tokenizer or default_path("byte_bpe_50k.json"), end_id), f"doc_id {doc_id}, part int, start_in_part long, n_tokens long, ids array<int>")
    encoded.write.options(**ORC).orc(path)


def _with_start(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows (part, start_in_part, ...) with start over all parts; parts: part, start_in_part, n_tokens of every document."""
    totals = parts.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with start over all parts."""
    rows = spark.read.orc(path)
    return _with_start(rows, rows)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values, offsets = np.asarray(ids.values, "<u4").view(np.uint8), np.asarray(ids.offsets, np.int64) * 4
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        names = [x for x in batch.schema.names if x != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])


def report(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Writes docs, reads them back: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens.orc")
    write(docs, path, tokenizer=tokenizer)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    rows = spark.read.orc(path)
    # The checksums are taken where the ids are read; only they and the places are joined.
    small = rows.mapInArrow(_crc, f"doc_id {doc_id}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return _with_start(small, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
