"""Algebra of half-open intervals [start, end) and of lines, on any DataFrame.

Every operator works within groups (a file, a user), so the keys are the partitioning; sorts are by start within a group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Unions of intervals that overlap or touch: keys, start, end. One sort: an island begins where no earlier end reaches.

    With width, what starts in one stretch of that width is merged first, so that of a key with very many intervals only islands meet."""
    if width:
        local = _islands(spans.select(*keys, start, end, F.floor(F.col(start) / width).alias("_w")), [*keys, "_w"], start, end)
        spans = local.drop("_w")
    return _islands(spans.select(*keys, start, end), keys, start, end)


def _islands(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = spans.withColumn("_fresh", fresh)
    islands = marked.withColumn("_island", F.sum("_fresh").over(w))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def subtract(spans: DataFrame, holes: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """What is in the union of spans and in no hole, as maximal intervals: a sweep over borders counts how many of either are open."""

    def borders(rows: DataFrame, kind: str) -> DataFrame:
        at = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d"))))
        opened = rows.where(F.col(start) < F.col(end)).select(*keys, at.alias("x"))
        return opened.select(*keys, "x.at", *(F.col("x.d").alias(k) if k == kind else F.lit(0).alias(k) for k in ("a", "b")))

    swept = borders(spans, "a").unionByName(borders(holes, "b")).groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*keys).orderBy("at")
    open_ = swept.select(*keys, "at", (F.sum("a").over(w) > 0).alias("_in"), (F.sum("b").over(w) > 0).alias("_out"), F.lead("at").over(w).alias("_next"))
    kept = open_.where("_in and not _out and _next is not null").select(*keys, F.col("at").alias(start), F.col("_next").alias(end))
    return merge(kept, keys, start, end)


def smallest_enclosing(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: tuple[str, str], span: tuple[str, str], point_id: str, tie: str, width: int | None = None) -> DataFrame:
    """points, with the shortest span that holds each (columns of spans; null if none does). Ties: the least `tie`.

    The keys make it a hash join with a range condition; the argmin is an aggregation, so one point's many spans need no sort. With width,
    spans are dealt over the stretches of that width they reach, and points meet only those of the stretch they start in, so that a key with very
    many of both is no one's task."""
    (ps, pe), (ss, se) = point, span
    own, asked, on = spans.select(*keys, ss, se, tie), points.select(*keys, point_id, ps, pe), list(keys)
    if width:
        own = own.where(F.col(ss) < F.col(se)).withColumn("_w", F.explode(F.sequence(F.floor(F.col(ss) / width), F.floor((F.col(se) - 1) / width))))
        asked, on = asked.withColumn("_w", F.floor(F.col(ps) / width)), [*keys, "_w"]
    pairs = asked.join(own, on).where((F.col(ss) <= F.col(ps)) & (F.col(pe) <= F.col(se)))
    best = pairs.groupBy(point_id).agg(F.min(F.struct((F.col(se) - F.col(ss)).alias("size"), F.col(tie).alias("tie"))).alias("_best"))
    return points.join(best.select(point_id, F.col("_best.tie").alias(tie)), point_id, "left")


def _line_starts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Of each text where its lines begin in bytes, and its size; a null text has no lines."""
    for value in batch.column(text).cast(pa.binary()):
        raw = value.as_buffer()
        data = np.empty(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)
        yield (np.empty(0, np.int64) if raw is None else np.concatenate(([0], np.flatnonzero(data == 10) + 1))), len(data)


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), start, n_bytes: where each line of a text begins in bytes. A final newline is followed by an empty line. A text's
    lines are found where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (starts, size) in enumerate(_line_starts(batch, text)):
                sizes = np.diff(starts, append=size + 1) - 1
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.full(len(starts), k))), pa.array(np.arange(1, len(starts) + 1, dtype=np.int32)), pa.array(starts.astype(np.int64)), pa.array(sizes.astype(np.int64))], [key, "line", "start", "n_bytes"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, line int, start long, n_bytes long")


def lines_at(texts: DataFrame, key: str, text: str, offsets: str) -> DataFrame:
    """key, offset, line for each of a text's offsets (an array of bytes' places): the last line that starts at or before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (starts, _) in enumerate(_line_starts(batch, text)):
                asked = np.array(batch.column(offsets)[k].as_py() or [], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.full(len(asked), k))), pa.array(asked), pa.array(np.searchsorted(starts, asked, "right").astype(np.int32))], [key, "offset", "line"])

    return texts.select(key, text, offsets).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, offset long, line int")


def offsets_to_lines(offsets: DataFrame, line_rows: DataFrame, key: str, offset: str = "offset") -> DataFrame:
    """As lines_at, where offsets are a table of their own: key, offset, line. Line starts and offsets are sorted together once, so no
    range join multiplies them."""
    both = offsets.select(key, F.col(offset).cast("long").alias(offset), F.lit(None).cast("int").alias("_line")).unionByName(line_rows.select(key, F.col("start").cast("long").alias(offset), F.col("line").cast("int").alias("_line")))
    w = Window.partitionBy(key).orderBy(F.col(offset), F.col("_line").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("line", F.max("_line").over(w)).where("_line is null").select(key, offset, "line")


def covers(outer: tuple[Column, Column], inner: tuple[Column, Column]) -> Column:
    """outer holds inner."""
    return (outer[0] <= inner[0]) & (inner[1] <= outer[1])
