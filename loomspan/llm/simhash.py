"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit where over half of the hashes of a text's word shingles have it. Fingerprints at `most` or fewer
differing bits are linked; a component is what links reach. Equal fingerprints are one node.

A table holds every fingerprint's Hamming distances to reference fingerprints, the pivots. Differences of these coordinates never exceed
the distance itself. FINE pivots are the first one with two bits turned: such a coordinate less the first says in how many of the two
bits a fingerprint differs from the first pivot. These coordinates, in `groups` groups, decide who meets: of two fingerprints at most `most` bits
apart, all coordinates of `groups` - `most` whole groups are equal, so each goes to one bucket for every choice of so many groups.
Within a bucket, rows sorted by the first coordinate are compared only while it differs by at most `most`, pairs whose maximum coordinate
difference over WIDE further pivots is larger are discarded, survivors are verified. A bucket gives links to the least fingerprint of
each part that hangs together, not its pairs.

A bucket over `chunk` is dealt in chunks, and every two chunks meet in a cell of their own. Where that took more than CELLS cells a row, the
other groups' bits are cut into PARTS parts, and a row goes to a cell for each choice of `most` parts that may differ: CELLS at most,
of 2 ** 9 different fingerprints at most. So a row has a bounded number of cells, and a cell of rows, whatever the bucket's size.

keep_one(alike=...) links by the texts themselves: two are linked if the Jaccard similarity of their sets of shingles is `alike` or more.
Fingerprints at that similarity are too far apart for blocks of bits (about 10 bits at 0.8), so buckets are BANDS bands of ROWS least
hashes of the set; in a bucket the pivots and the distance `most` leave candidates, and the sets of shingles decide. At a similarity of 0.8
a pair has no common bucket with probability 3e-6 ((1 - 0.8 ** ROWS) ** BANDS), less above it. Texts of equal sets are one node. What of a
bucket hangs together by its bits is a cell, of which there is one however many buckets hold it; only then do the sets come.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; repeated rows get a row each; a component's
id is its least doc_id (null if it has none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, join_spread, let, materialize, named, texts
from .components import components

SEED = 42
FINE, WIDE = 32, 23
_FIRST, *_OTHERS = np.random.default_rng(20240501).integers(0, 1 << 64, 1 + WIDE, dtype=np.uint64)
#: The first pivot and those that tell far fingerprints apart; the first with two bits turned, bit by bit.
_PIVOTS = np.array([_FIRST, *_OTHERS], np.uint64)
_TURNED = _FIRST ^ (np.uint64(3) << np.arange(0, 64, 2, dtype=np.uint64))
PARTS = 12
#: Buckets of similar sets: so many bands, each of so many least hashes.
BANDS, ROWS = 24, 4
_TIMES, _PLUS = np.random.default_rng(20240502).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The hashes of a text's word shingles, in order and with repeats."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - width + 1)
    starts, stops = first[:n].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 17):
        h = hashes[lo : lo + (1 << 17)].astype("<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    return majority(shingles(text, width))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes of a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(own), 4096):
        least = np.minimum(least, (own[lo : lo + 4096, None] * _TIMES + _PLUS).min(0))
    return (least * _PLUS[::-1]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)


def _sketches(width: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [x for x in batch.schema.names if x != "text"]
            node, fp, keys = [], [], []
            for t in texts(batch):
                h = shingles(t, width)
                own = np.unique(h)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                fp.append(majority(h))
                keys.append(band_keys(own).view(np.int64) if len(own) else np.empty(0, np.int64))
            made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *made, pa.array(keys, pa.list_(pa.int64()))], [*names, "fp", "bits", "keys"])

    return run


def _sets(width: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal rows of a task, one gets its set."""
        seen: set[int] = set()
        for batch in batches:
            fps, own = [], []
            for fp, t in zip(batch.column("fp").to_pylist(), texts(batch), strict=True):
                if fp not in seen:
                    seen.add(fp)
                    fps.append(fp)
                    own.append(np.unique(shingles(t, width)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(own, pa.binary())], ["fp", "own"])

    return run


def _fingerprints(width: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [x for x in batch.schema.names if x != "text"]
            own = np.array([fingerprint(t, width) for t in texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(own.view(np.int64))], [*names, "fp"])

    return run


def _signed(x: int) -> int:
    return int(np.array(x, np.uint64).astype(np.int64))


def _choices(groups: int, most: int) -> list[tuple[int, ...]]:
    """The groups whose coordinates are equal, in every way that differences can leave some."""
    return list(combinations(range(groups), groups - most))


def _group_of(groups: int) -> list[list[int]]:
    """The fine pivots of each group."""
    edges = [FINE * k // groups for k in range(groups + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def bucket_keys(fp: Column, groups: int, most: int) -> Column:
    """An array with a key for each choice of groups: their coordinates, less the first."""
    first = F.bit_count(fp.bitwiseXOR(F.lit(_signed(_FIRST))))

    def coded(own: list[int], d0: Column) -> Column:
        code = F.lit(0)
        for k in own:
            differ = F.shiftright(d0 + 2 - F.bit_count(fp.bitwiseXOR(F.lit(_signed(_TURNED[k])))), 1)
            code = code * 3 + differ
        return code.cast("long")

    def keys(codes: Column) -> Column:
        return F.array(*(sum((F.shiftleft(codes[g], 20 * k) for k, g in enumerate(own[1:], 1)), codes[own[0]]) for own in _choices(groups, most)))

    return let(let(first, lambda d0: F.array(*(coded(own, d0) for own in _group_of(groups)))), keys)


def _parts(groups: int, most: int) -> list[tuple[int, int, int]]:
    """For each choice of groups (by its number) and each choice of parts of the other groups' bits: the bits that are equal."""
    out, everything = [], (1 << 64) - 1
    for band, own in enumerate(_choices(groups, most)):
        bits = [2 * k + b for g, ks in enumerate(_group_of(groups)) if g not in own for k in ks for b in (0, 1)]
        edges = [len(bits) * k // PARTS for k in range(PARTS + 1)]
        part = [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        out += [(band, k, _signed(everything ^ sum(x))) for k, x in enumerate(combinations(part, most))]
    return out


def near_links(cell: np.ndarray, fp: np.ndarray, most: int, pivots: np.ndarray = _PIVOTS, linked: Any = None) -> np.ndarray:
    """For each row the place of a representative of the rows of its cell that it hangs together with. linked, if given, says of the
    places of near rows which of them are links."""
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int16)
    order = np.lexsort((fp, table[:, 0], cell))
    cell, fp, table = cell[order], fp[order], table[order]
    label = np.arange(len(fp))
    i, lag = np.arange(len(fp)), 0
    while True:
        lag += 1
        i = i[i + lag < len(fp)]
        j = i + lag
        near = (cell[i] == cell[j]) & (table[j, 0] - table[i, 0] <= most)
        i = i[near]
        if not len(i):
            break
        a = i[label[i] != label[i + lag]]
        for lo in range(1, len(pivots), 8):
            a = a[np.abs(table[a, lo : lo + 8] - table[a + lag, lo : lo + 8]).max(1) <= most] if len(a) else a
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= most]
        if linked is not None and len(a):
            a = a[linked(order[a], order[a + lag])]
        while len(a):  # joins the labels, least first
            low, high = np.minimum(label[a], label[a + lag]), np.maximum(label[a], label[a + lag])
            np.minimum.at(label, high, low)
            while not np.array_equal(label, label[label]):
                label = label[label]
            a = a[label[a] != label[a + lag]]
    out = np.empty(len(fp), np.int64)
    out[order] = order[label]
    return out


def _by_cell(columns: tuple[str, ...], of: Any) -> Any:
    """of(cells, rows) for whole cells; rows come sorted by band, pair, key, and the last cell of a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("band", "pair", "key", *columns)
        left: tuple[np.ndarray, ...] = (np.empty(0, np.int64),) * len(names)

        def whole(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            change = np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0)
            return of(np.concatenate(([0], np.cumsum(change))), *rows[3:])

        for batch in batches:
            rows = tuple(np.concatenate((old, batch.column(x).to_numpy())) for old, x in zip(left, names, strict=True))
            same = np.all([x == x[-1] for x in rows[:3]], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            left = tuple(x[cut:] for x in rows)
            if cut:
                yield whole(tuple(x[:cut] for x in rows))
        if len(left[0]):
            yield whole(left)

    return run


def _links(most: int) -> Any:
    def linked(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        to = near_links(cell, fp.view(np.uint64), most)
        moved = to != np.arange(len(to))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[to[moved]])], ["a", "b"])

    return _by_cell(("fp",), linked)


def _near_cells(most: int) -> Any:
    """Rows of a cell that hang together by their bits, as a cell of their own, named by a hash of its rows: what meets in several buckets
    is one cell."""

    def parted(cell: np.ndarray, fp: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        to = near_links(cell, bits.view(np.uint64), most)
        order = np.lexsort((fp, to))
        _, first, many = np.unique(to[order], return_index=True, return_counts=True)
        kept = [order[a : a + n] for a, n in zip(first[many > 1], many[many > 1], strict=True)]
        names = np.array([xxhash.xxh64_intdigest(fp[own].tobytes(), SEED) for own in kept], np.uint64).view(np.int64)
        rows = np.concatenate([np.empty(0, np.int64), *kept])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(x) for x in kept])), pa.array(fp[rows]), pa.array(bits[rows])], ["cell", "fp", "bits"])

    return _by_cell(("fp", "bits"), parted)


def similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, alike: float) -> np.ndarray:
    """Of pairs of sets (sorted arrays), which have a Jaccard similarity of alike or more."""

    def holds(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < alike * max(len(x), len(y)):
            return False
        both = np.sort(np.concatenate((x, y)))
        common = int((both[1:] == both[:-1]).sum())
        return common >= alike * (len(both) - common)

    return np.array([holds(sets[i], sets[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)


def _alike_links(most: int, alike: float) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, which may go on in the next batch."""
        at: int | None = None
        rows: list[tuple[int, int, bytes]] = []

        def linked() -> pa.RecordBatch:
            fp, bits = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            to = near_links(np.zeros(len(rows), np.int64), bits.view(np.uint64), most, linked=lambda a, b: similar(sets, a, b, alike))
            moved = to != np.arange(len(to))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[to[moved]])], ["a", "b"])

        for batch in batches:
            for cell, fp, bits, own in zip(*(each(batch.column(x)) for x in ("cell", "fp", "bits", "own")), strict=True):
                if cell != at:
                    if len(rows) > 1:
                        yield linked()
                    at, rows = cell, []
                rows.append((fp, bits, own))
        if len(rows) > 1:
            yield linked()

    return run


def link(distinct: DataFrame, *, most: int = 3, groups: int = 6, chunk: int = 512, cells: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect what differs in at most `most` bits."""
    choices = comb(PARTS, most)
    bands = distinct.select("fp", F.posexplode(bucket_keys(F.col("fp"), groups, most)).alias("band", "key"))
    met = _met(bands.select("fp", F.col("band").cast("long").alias("band"), "key"))
    parts = F.slice(F.lit([m for _, _, m in _parts(groups, most)]), (F.col("band") * choices + 1).cast("int"), F.lit(choices))
    large = F.transform(parts, lambda m, k: named(pair=(-1 - k).cast("long"), key=F.col("fp").bitwiseAND(m)))
    chunks = F.transform(_pairs(chunk), lambda pair: named(pair=pair, key=F.col("key")))
    own = F.when(F.col("n") > chunk * (choices if cells is None else cells), large).otherwise(chunks)
    dealt = met.select("band", "fp", F.inline(own)).repartition("band", "pair", "key").sortWithinPartitions("band", "pair", "key")
    return dealt.select("band", "pair", "key", "fp").mapInArrow(_links(most), "a long, b long")


def _met(bands: DataFrame) -> DataFrame:
    """bands (fp, band, key, ...) of buckets that hold more than one row, with the bucket's size n."""
    return bands.join(bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), ["band", "key"])


def _pairs(chunk: int) -> Column:
    """The cells that a row of a bucket (fp, n) goes to: its chunk with every chunk."""
    chunks = F.ceil(F.col("n") / chunk)

    def paired(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda k: F.least(own, k) * chunks + F.greatest(own, k))

    return let(F.pmod(F.xxhash64("fp"), chunks), paired)


def near_cells(bands: DataFrame, *, most: int, chunk: int = 512) -> DataFrame:
    """bands: fp (a set), bits (its fingerprint), band, key, n. cell, fp, bits: the sets that buckets leave to be compared, each cell once."""
    dealt = bands.withColumn("pair", F.explode(_pairs(chunk))).select("band", "pair", "key", "fp", "bits")
    dealt = dealt.repartition("band", "pair", "key").sortWithinPartitions("band", "pair", "key")
    return dealt.mapInArrow(_near_cells(most), "cell long, fp long, bits long").distinct()


def link_alike(cells: DataFrame, sets: DataFrame, *, alike: float, most: int) -> DataFrame:
    """Links (a, b) that connect sets (fp, own) of a cell at a similarity of alike or more."""
    own = cells.join(sets, "fp").select("cell", "fp", "bits", "own").repartition("cell").sortWithinPartitions("cell")
    return own.mapInArrow(_alike_links(most, alike), "a long, b long")


def fingerprints(docs: DataFrame, *ids: str | Column, width: int = 3) -> DataFrame:
    """The columns ids of docs, and fp: the fingerprint of text as a signed number."""
    own = docs.select(*ids, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(_fingerprints(width), f"{kinds}, fp long")


def cluster(prints: DataFrame, *, most: int = 3, groups: int = 6, chunk: int = 512) -> DataFrame:
    """prints: doc_id, fp, written to the shared folder. Per distinct fp: fp, component_id, n (its rows)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    return _named(distinct, link(distinct, most=most, groups=groups, chunk=chunk))


def _named(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """distinct: fp, first, n. fp, n and component_id, the least first of what links connect."""
    parts = materialize(components(links), "parts")
    linked = materialize(parts.join(distinct, parts["node"] == distinct["fp"]).select("fp", "root", "first"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n")), "least")
    linked = join_spread(linked.select("fp", "root"), least, "root").select("fp", "component")
    return distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, *, width: int = 3, most: int = 3, groups: int = 6, chunk: int = 512) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(fingerprints(docs, "doc_id", width=width), "prints")
    found = join_spread(prints, materialize(cluster(prints, most=most, groups=groups, chunk=chunk), "clusters"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def cluster_alike(docs: DataFrame, prints: DataFrame, ids: list[str], *, width: int, alike: float, most: int = 24, chunk: int = 512) -> DataFrame:
    """Per distinct set of shingles (fp of prints): fp, component_id. ids name the columns that docs and prints share; docs has text, too."""
    one = F.min(F.struct(*ids)).alias("one")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("bits").alias("bits"), one, F.first("keys").alias("keys"), F.count("*").alias("n")), "distinct")
    bands = distinct.select("fp", "bits", F.posexplode("keys").alias("band", "key"))
    cells = materialize(near_cells(_met(bands.withColumn("band", F.col("band").cast("long"))), most=most, chunk=chunk), "cells")
    wanted = cells.select("fp").distinct().join(distinct, "fp").select("fp", "one.*")
    sets = materialize(docs.select(*ids, "text").join(wanted, ids).select("fp", "text").mapInArrow(_sets(width), "fp long, own binary"), "sets")
    return _named(distinct.select("fp", "first", "n"), link_alike(cells, sets, alike=alike, most=most))


def keep_one(docs: DataFrame, *, width: int = 3, alike: float | None = None, **options: int) -> DataFrame:
    """docs with one row of each component: the least doc_id (null last), of its rows the least hash of the text. With alike, components
    are of texts whose shingles have that similarity; without, of near fingerprints."""
    k, h, fp = (f"__{x}_{len(docs.columns)}" for x in ("id", "hash", "fp"))
    keyed = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).withColumn(h, F.xxhash64("text"))
    if alike is None:
        prints = materialize(fingerprints(keyed, "doc_id", F.col(k), F.col(h), width=width), "prints")
        found = cluster(prints, **options)
    else:
        doc_id = docs.schema["doc_id"].dataType.simpleString()
        made = keyed.select("doc_id", k, h, "text").mapInArrow(_sketches(width), f"doc_id {doc_id}, {k} string, {h} long, fp long, bits long, keys array<long>")
        prints = materialize(made, "prints")
        found = cluster_alike(keyed, prints, [k, h], width=width, alike=alike, **options)
    # The first row of each fingerprint, of these the first of each component. Of a component without any doc_id, component_id is null:
    # such rows stand for themselves by their fingerprint.
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(k), F.col(h))).alias("w"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), "fp"))
    won = first.join(found, "fp").groupBy(group.alias("g")).agg(F.min("w").alias("w")).select(f"w.{k}", f"w.{h}")
    times = f"__n_{len(docs.columns)}"
    won = materialize(won.join(prints.groupBy(k, h).agg(F.count("*").alias(times)), [k, h]), "won")
    repeated = keyed.join(won.where(F.col(times) > 1), [k, h]).dropDuplicates([k, h])  # rows equal in id and text
    return keyed.join(won.where(F.col(times) == 1), [k, h]).unionByName(repeated).select(*docs.columns)
