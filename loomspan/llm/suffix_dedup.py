"""Exact substring deduplication by a depth-limited radix sort of suffixes.

A suffix, cut at `depth` bytes, is a window; equal windows are what is wanted. They go through passes by digits of their bytes, and a
group of windows leaves as soon as a pass shows that it holds one only, or only equal ones:

1. A window's first digit is its anchor: its 32-byte gram with the least hash, the leftmost of equals, so that equal windows have it at
   one place. Windows that follow each other and have their anchor at one place form a run, which stays one row while no digit tells its
   windows apart (a run holds some 85). Grams of one run only are unique: no window of theirs is repeated.
2. The whole region that a run's windows cover. Runs with equal regions are repeated from end to end; one of them goes on.
3. Under a gram of several regions, the regions' bytes meet, and their windows are sorted by 8 bytes at a time, most significant first, down
   to `depth`; after each digit, groups of one window leave. What is left at the end are the repeated windows.

A group of more than `room` regions doesn't meet in one task. It is dealt anew by its next digits: windows are split by how far the anchor is from
their start into ranges of a fourth, and what the windows of a range have in common, up to the whole window, is the digit. What of a run is in
a range is its region there, and pass 2 is made again. At the last range, of one window, no group holds two regions.

Grams and regions are compared by hashes of 64 bits each, of different functions, bytes from pass 3 on. No window is left out, whatever its
group's size: groups are counted (before the shuffle too), and only those of bounded size are brought together.

A document is a row; a row is named by doc_id and a hash of its text, so equal rows are copies of each other. Defined results: a null
text is empty; texts under `depth` bytes keep everything; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, each, join_spread, materialize, texts as texts_of

GRAM = 32
_BLOCK = 1 << 20
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h = _BYTE[data]
    for k in range(5):  # 32 bytes, by doubling
        step = 1 << k
        h = h[:-step] * _ODD[k] + h[step:]
    h ^= h >> np.uint64(29)
    h *= _ODD[5]
    h ^= h >> np.uint64(32)
    return h


def runs(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """data: texts behind each other, ends: where each ends. Of each run: first window, windows, its anchor's place and hash."""
    n = len(data) - depth + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    h = _gram_hashes(data)
    m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, step = depth - GRAM + 1, 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    m = np.minimum(m[:n], m[width - step : width - step + n])
    anchor = (m & _LOW).astype(np.int64)
    inside = np.ones(n, bool)  # of one text
    for e in ends[:-1]:
        inside[max(0, e - depth + 1) : e] = False
    begin = inside.copy()
    begin[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(begin)
    last = inside.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    return first, np.flatnonzero(last) - first + 1, anchor[first], h[anchor[first]].view(np.int64)


def _anchors(depth: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):
                rows, size, many = [], 0, 0
                while at + many < len(texts) and (not many or size + len(texts[at + many]) <= _BLOCK):
                    size += len(texts[at + many])
                    many += 1
                own = texts[at : at + many]
                whole = own[0] if many == 1 else b"".join(own)
                data, ends = np.frombuffer(whole, np.uint8), np.cumsum([len(x) for x in own])
                for lo in range(0, max(1, len(whole) - depth + 1), _BLOCK if many == 1 else len(whole) or 1):
                    piece = data[lo : lo + _BLOCK + depth - 1] if many == 1 else data
                    first, count, anchor, gram = runs(piece, np.array([len(piece)]) if many == 1 else ends, depth)
                    if not len(first):
                        continue
                    region = np.array([digest(whole[a : a + k]) for a, k in zip((first + lo).tolist(), (count + depth - 1).tolist(), strict=True)], np.uint64)
                    text = np.searchsorted(ends, first + lo, "right")
                    rows.append((text + at, first + lo - (ends - [len(x) for x in own])[text], count, anchor - first, gram, region.view(np.int64)))
                at += many
                if rows:
                    text, start, count, anchor, gram, region = (np.concatenate(x) for x in zip(*rows, strict=True))
                    take = pa.array(text)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(start << 16 | count << 8 | anchor), pa.array(gram), pa.array(region)], ["doc_id", "h", "run", "gram", "region"])

    return run


def _unpacked(run: int) -> tuple[int, int, int]:
    """Of a run: its first window, its windows, how far its anchor is from its first window."""
    return run >> 16, run >> 8 & 255, run & 255


def _regions(depth: int, hot: bool) -> Any:
    """The bytes of the regions asked for, of grams that are hot or of those that aren't. Of equal rows of a task, one is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            ids, hs = batch.column("doc_id"), batch.column("h")
            rows: list[list[Any]] = [[], [], [], [], [], []]
            for k, (key, text, info) in enumerate(zip(zip(ids.to_pylist(), hs.to_pylist(), strict=True), texts_of(batch), each(batch.column("info")), strict=True)):
                if key in met:
                    continue
                met.add(key)
                for x in info:
                    if x["gram"] is not None and x["hot"] == hot:
                        lo, n, anchor = _unpacked(x["run"])
                        for column, value in zip(rows, (k, x["gram"].to_bytes(8, "big", signed=True), lo, anchor, x["alone"], text[lo : lo + n + depth - 1]), strict=True):
                            column.append(value)
            take = pa.array(rows[0], pa.int64())
            own = [pa.array(x, t) for x, t in zip(rows[1:], (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(take), hs.take(take), *own], ["doc_id", "h", "digit", "start", "anchor", "alone", "region"])

    return run


def repeated_windows(regions: list[bytes], group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, place in it) of the windows of regions that another window of their group equals; group: a number for each region.

    Radix passes by 8 bytes, most significant first. A pass sorts only groups in which the digit differs."""
    if not regions:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(b"".join(regions), np.uint8)
    digits = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        digits |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * (7 - k))
    sizes = np.array([len(r) for r in regions])
    own = np.repeat(np.arange(len(regions)), sizes - depth + 1)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.arange(len(own)) - np.repeat(np.cumsum(sizes - depth + 1) - (sizes - depth + 1), sizes - depth + 1) + begin[own]
    g = np.asarray(group)[own]
    for deep in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        d = digits[at + deep]
        if deep:  # groups come together and in order; those of one digit stay as they are
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            same = np.logical_and.reduceat(d == np.repeat(d[first], np.diff(first, append=len(g))), first)
            mixed = np.flatnonzero(np.repeat(~same, np.diff(first, append=len(g))))
            if not len(mixed):
                continue
        else:
            mixed = np.arange(len(g))
        order = mixed[np.lexsort((d[mixed], g[mixed]))]
        at[mixed], own[mixed], d[mixed], g[mixed] = at[order], own[order], d[order], g[order]
        fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        g = np.cumsum(fresh) - 1
        stays = np.bincount(g)[g] > 1
        at, own, g = at[stays], own[stays], g[stays]
        if not len(at):
            break
    return own, at - begin[own]


def _compare(depth: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by digit; the last digit of a batch waits for the next."""
        left: pa.Table | None = None

        def compared(rows: pa.Table) -> pa.RecordBatch:
            start, alone = rows["start"].to_numpy(), rows["alone"].to_numpy(zero_copy_only=False)
            own, place = repeated_windows(rows["region"].to_pylist(), _changes(rows["digit"]).cumsum(), depth)
            own, place = own[alone[own]], place[alone[own]]
            order = np.lexsort((place, own))
            own, a = own[order], (start[own] + place)[order]
            # Windows that follow each other or overlap are one span.
            fresh = np.ones(len(a), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (a[1:] > a[:-1] + depth)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(a))[: len(first)] - 1
            take = pa.array(own[first])
            ids, hs = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows[c].combine_chunks().take(take) for c in ("doc_id", "h")))
            return pa.RecordBatch.from_arrays([ids, hs, pa.array(a[first]), pa.array(a[last] + depth)], ["doc_id", "h", "start", "end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            cut = int(np.flatnonzero(_changes(rows["digit"]))[-1:].sum())
            left = rows.slice(cut)
            if cut:
                yield compared(rows.slice(0, cut))
        if left is not None and left.num_rows:
            yield compared(left)

    return run


def _changes(digit: pa.ChunkedArray) -> np.ndarray:
    """Where a sorted column has another value than before; the first row has none before."""
    values = digit.combine_chunks()
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return np.concatenate(([False], pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union, as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remove(depth: int, with_text: bool) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, sha, kept_texts, all_spans = [], [], [], [], []
            for text, info, starts in zip(texts_of(batch), each(batch.column("info")), each(batch.column("starts")), strict=True):
                own = [(lo, lo + n + depth - 1) for lo, n, _ in (_unpacked(x["run"]) for x in info or [] if x["repeated"])]
                spans = merged(own + [(x["start"], x["end"]) for x in starts or []])
                at, kept = 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                removed.append(len(text) - len(rest))
                n_spans.append(len(spans))
                sha.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept_texts.append(rest)
                    all_spans.append([{"start": a, "end": b} for a, b in spans])
            out = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                out += [pa.array(kept_texts, pa.binary()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["h"] == b["h"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _split(rows: DataFrame, width: int, depth: int) -> DataFrame:
    """rows (a run each), a row for each range of `width` of the distance from a window's start to its anchor: what the range's windows cover
    is the region, what they have in common is the digit."""
    size, anchor = F.length("region"), F.col("anchor")
    least = F.greatest(anchor - (size - depth), F.lit(0))
    ranged = rows.withColumn("k", F.explode(F.sequence(F.floor(least / width).cast("int"), F.floor(anchor / width).cast("int"))))
    lo, hi = F.col("k") * width, F.least(F.col("k") * width + (width - 1), F.lit(depth - GRAM))
    first, last = anchor - F.least(hi, anchor), anchor - F.greatest(lo, least)  # windows by place in the region
    digit = F.concat(F.concat(F.lit(f"{width}|"), F.col("k").cast("string"), F.lit("|")).cast("binary"), F.substring("region", (anchor - lo + 1).cast("int"), (lo - hi + depth).cast("int")))
    return ranged.select("doc_id", "h", digit.alias("digit"), (F.col("start") + first).alias("start"), (anchor - first).alias("anchor"), "alone", F.substring("region", (first + 1).cast("int"), (last - first + depth).cast("int")).alias("region"))


def _parted(hot: DataFrame, depth: int, room: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """hot: rows of groups that are too large for a task. (Rows of groups that aren't any more; spans of rows that are repeated from end to
    end.)"""
    near, spans, width = [], [], depth - GRAM + 1
    while width > 1 and not hot.isEmpty():
        width = -(-width // 4)
        rows = materialize(_split(hot, width, depth).withColumn("same", F.md5(F.concat("digit", "region"))), f"split{width}", "zstd")
        one = F.min(F.struct("doc_id", "h", "start", "anchor", "alone", "region")).alias("one")
        equal = materialize(rows.groupBy("digit", "same").agg(F.count("*").alias("n"), one), f"equal{width}", "zstd")
        again = join_spread(rows.where("alone").select("doc_id", "h", "start", F.length("region").alias("size"), "same"), equal.where("n > 1").select("same", "n"), "same", "left_semi", total=rows.count())
        spans.append(again.select("doc_id", "h", "start", (F.col("start") + F.col("size")).alias("end")))
        first = equal.select("one.doc_id", "one.h", "digit", "one.start", "one.anchor", (F.col("one.alone") & (F.col("n") == 1)).alias("alone"), "one.region")
        counts = materialize(equal.groupBy("digit").agg(F.count("*").alias("n")).where("n > 1"), f"counts{width}")
        met = join_spread(first, counts, "digit", total=equal.count())
        near.append(met.where(F.col("n") <= room).drop("n"))
        hot = met.where(F.col("n") > room).drop("n")
    return near, spans


def remove_repeats(docs: DataFrame, *, depth: int = 200, with_text: bool = False, room: int = 512) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept (the bytes) and spans
    (byte ranges removed, end exclusive). Removed is each byte within a string of depth bytes that also starts anywhere else."""
    if not GRAM <= depth < 255 + GRAM:
        raise ValueError(f"depth must be from {GRAM} to {254 + GRAM}")
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    anchors = texts.where(F.octet_length("text") >= depth).select("doc_id", "h", "text").mapInArrow(_anchors(depth), f"doc_id {doc_id}, h long, run long, gram long, region long")
    # Pass 1: grams of one run only leave.
    grams = materialize(anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("region").alias("a"), F.max("region").alias("b")).where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("several")), "grams")
    met = materialize(anchors.join(grams, "gram"), "met")
    # Pass 2: under a gram of several regions, a region of several runs is repeated; one run of each region goes on.
    mixed = met.where("several")
    regions = materialize(mixed.groupBy("gram", "region").agg(F.count("*").alias("n"), F.min(F.struct("h", "run", "doc_id")).alias("one")), "regions")
    large = materialize(regions.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > room), "large")
    one = join_spread(regions.withColumnRenamed("n", "times"), large, "gram", "left", total=regions.count())
    one = one.select("one.doc_id", "one.h", F.struct(F.col("one.run").alias("run"), "gram", F.lit(False).alias("repeated"), (F.col("times") == 1).alias("alone"), F.col("n").isNotNull().alias("hot")).alias("x"))
    none = F.lit(None).cast("long")
    repeated = met.where("not several").select("doc_id", "h", "run").unionByName(join_spread(mixed, regions.where("n > 1").select("gram", "region", "n"), ["gram", "region"], "left_semi").select("doc_id", "h", "run"))
    info = repeated.select("doc_id", "h", F.struct("run", none.alias("gram"), F.lit(True).alias("repeated"), F.lit(False).alias("alone"), F.lit(False).alias("hot")).alias("x"))
    info = info.unionByName(one).groupBy("doc_id", "h").agg(F.collect_set("x").alias("info"))  # equal rows have equal runs
    has = F.col("info").isNotNull()
    known = materialize(
        texts.join(info, _same(texts, info), "left").select(texts["doc_id"], texts["h"], "info", F.octet_length("text").cast("long").alias("n_bytes"), F.when(has, F.col("text")).alias("text"), F.when(~has, F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"), *[F.when(~has, F.col("text")).alias("whole")] * with_text),
        "known",
        "zstd",
    )
    discard(grams, met, regions)
    # Pass 3: the windows of what is left.
    asked = known.where(F.exists("info", lambda x: x["gram"].isNotNull())).select("doc_id", "h", "text", "info")
    kinds = f"doc_id {doc_id}, h long, digit binary, start long, anchor long, alone boolean, region binary"
    hot = asked.where(F.exists("info", lambda x: x["hot"])).mapInArrow(_regions(depth, True), kinds).dropDuplicates(["doc_id", "h", "start"])
    near, equal = _parted(materialize(hot, "hot", "zstd"), depth, room)
    near.append(asked.mapInArrow(_regions(depth, False), kinds))
    met_again = reduce(DataFrame.unionByName, near).repartition("digit").sortWithinPartitions("digit")
    spans = reduce(DataFrame.unionByName, [met_again.mapInArrow(_compare(depth), f"doc_id {doc_id}, h long, start long, end long"), *equal])
    starts = spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("starts"))
    candidates = known.where(has)
    cut = candidates.join(starts, _same(candidates, starts), "left").select(candidates["doc_id"], "n_bytes", "text", "info", "starts")
    kinds = f"doc_id {doc_id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:long,end:long>>" * with_text
    zero = F.lit(0).cast("long")
    clean = known.where(~has).select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", *[F.col("whole").cast("binary").alias("kept"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")] * with_text)
    return cut.mapInArrow(_remove(depth, with_text), kinds).unionByName(clean)
