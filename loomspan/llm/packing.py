"""Best-fit packing by a linear grouping scheme.

How documents are packed depends on their lengths alone, of which there are at most `capacity`. So the packing is planned on
the counts of lengths: lengths over a sixteenth of the capacity, in descending order, are cut into groups of equal cardinality
and rounded up to the longest of their group; a linear programme over configurations of these few sizes (columns are found
by a knapsack) says how often each configuration is used, rounded down; actual lengths take the places of the rounded ones; what is
left over, and the small lengths, go best-fit into the room that remains. The plan is a list of runs: pieces of one length, by rank,
go to consecutive sequences at one offset.

A piece's rank among those of its length is its number within its part (a partition of the tokenised pieces) plus the counts of
the parts before. No group of pieces is brought together, whatever share of them has one length; only the counts by length (at
most `capacity`) reach the driver.

Defined results: a null text is empty (only the end id); repeated rows are packed each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import byte_bpe, default_path

END = 2


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: all but the first are full."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _cut(tokenizer: str, end_id: int, capacity: int, with_ids: bool) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = byte_bpe(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                rows: list[list[Any]] = [[] for _ in range(7)]
                for k, packed in enumerate(encoder.encode(batch.column("text").to_pylist())):
                    packed += end
                    for i, (start, length) in enumerate(pieces_of(len(packed) // 4, capacity)):
                        ids = packed[4 * start : 4 * (start + length)]
                        for column, value in zip(rows, (k, i, start, length, zlib.crc32(ids), seen[length], ids), strict=True):
                            column.append(value)
                        seen[length] += 1
                own = np.array(rows[0], np.int64)
                out = [batch.column("doc_id").take(pa.array(own)), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5]), pa.array(np.full(len(own), part, np.int32)), pa.array(rows[5], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "within"]
                if with_ids:
                    out.append(pa.array([np.frombuffer(x, "<i4") for x in rows[6]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


# ---- the plan, on counts of lengths


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: its worth, and how many it has of each size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small, value = sizes[order], worth[order]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = np.searchsorted(small, c, "right")
        if n:
            total = best[c - small[:n]] + value[:n]
            k = int(np.argmax(total))
            if total[k] > best[c] + 1e-12:
                best[c], last[c] = total[k], order[k]
    many, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            many[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), many


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.002, rounds: int = 1500) -> list[tuple[int, np.ndarray]]:
    """How often to use which configuration: the linear programme's optimum (to within gap) by column generation, rounded down."""
    n = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(rounds):
        worth = np.maximum(inverse.sum(0), 0)
        value, many = _knapsack(sizes, worth, capacity)
        if value <= 1 + gap:
            break
        change = inverse @ many
        able = change > 1e-9
        if not able.any():
            break
        ratio = np.where(able, amount / np.where(able, change, 1), np.inf)
        leave = int(np.argmin(ratio))
        amount = amount - ratio[leave] * change
        amount[leave] = ratio[leave]
        columns[:, leave] = many
        pivot = inverse[leave] / change[leave]
        inverse = inverse - np.outer(change, pivot)
        inverse[leave] = pivot
    return [(int(x + 1e-6), columns[:, k].astype(np.int64)) for k, x in enumerate(amount) if x + 1e-6 >= 1 and n]


class _Rooms:
    """Runs of sequences (first, count, used) by the room they have."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by, self.rooms, self.next = capacity, {}, [], 0

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self.by:
                self.by[room] = []
                bisect.insort(self.rooms, room)
            self.by[room].append((first, count))

    def take(self, length: int, most: int) -> tuple[int, int, int]:
        """The fullest sequences with room for length: (first, count up to most, room); new ones if none has."""
        k = bisect.bisect_left(self.rooms, length)
        if k == len(self.rooms):
            count = -(-most // (self.capacity // length))
            self.next += count
            return self.next - count, count, self.capacity
        room = self.rooms[k]
        first, count = self.by[room].pop()
        if count > most:
            self.by[room].append((first + most, count - most))
            count = most
        if not self.by[room]:
            del self.by[room]
            self.rooms.pop(k)
        return first, count, room


def plan(counts: dict[int, int], capacity: int, groups: int = 96) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every rank of every length."""
    runs: list[tuple[int, int, int, int, int]] = []
    placed = dict.fromkeys(counts, 0)
    rooms = _Rooms(capacity)

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, placed[length], count, sequence, offset))
        placed[length] += count

    large = [(x, n) for x, n in sorted(counts.items(), reverse=True) if n and x > capacity // 16]
    total = sum(n for _, n in large)
    if total:
        # Groups of equal cardinality: each a list of [length, count], longest first.
        size, members, room = -(-total // groups), [[]], -(-total // groups)
        for length, n in large:
            while n:
                if not room:
                    members.append([])
                    room = size
                m = min(n, room)
                members[-1].append([length, m])
                n, room = n - m, room - m
        by_size: dict[int, list[list[int]]] = {}
        for m in members:
            by_size.setdefault(m[0][0], []).extend(m)
        sizes = np.array(list(by_size), np.int64)
        pools = list(by_size.values())
        demand = np.array([sum(n for _, n in p) for p in pools], float)
        for use, many in configurations(sizes, demand, capacity):
            slots = [k for k, m in enumerate(many) for _ in range(m)]
            use = min([use, *(sum(n for _, n in pools[k]) // int(many[k]) for k in set(slots))])
            first, rooms.next = rooms.next, rooms.next + use
            used = [(first, use, 0)]  # runs of sequences, and what is in them
            for k in slots:
                after = []
                for start, count, offset in used:
                    while count:
                        while not pools[k][0][1]:
                            pools[k].pop(0)
                        length, n = pools[k][0]
                        m = min(n, count)
                        place(length, m, start, offset)
                        after.append((start, m, offset + length))
                        pools[k][0][1] -= m
                        start, count = start + m, count - m
                used = after
            for start, count, offset in used:
                rooms.put(capacity - offset, start, count)
    for length in sorted(counts, reverse=True):
        while left := counts[length] - placed[length]:
            first, count, room = rooms.take(length, left)
            if room == capacity:  # new sequences take as many as fit
                offset = 0
                while (left := counts[length] - placed[length]) and offset + length <= capacity:
                    m = min(count, left)
                    place(length, m, first, offset)
                    rooms.put(capacity - offset - length, first + m, 0)
                    if m < count:
                        rooms.put(capacity - offset, first + m, count - m)
                    offset, count = offset + length, m
                rooms.put(capacity - offset, first, count)
            else:
                place(length, count, first, capacity - room)
                rooms.put(room - length, first, count)
    return runs


def _assign(plan_: Any) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first_rank, first_sequence, offset = plan_.value
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            k = np.searchsorted(key, (length << 44) + rank, "right") - 1
            sequence = first_sequence[k] + (rank - first_rank[k])
            names = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset[k])], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, capacity: int = 1024, tokenizer: str | None = None, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    spark = docs.sparkSession
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {doc_id}, piece int, start long, length long, ids_crc32 long, part int, within long" + ", ids array<int>" * with_ids
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer or default_path("byte_bpe_50k.json"), end_id, capacity, with_ids), kinds), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    runs = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(((table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 3], table[:, 4]))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = pieces.join(before, ["part", "length"]).select(*kept, (F.col("before") + F.col("within")).alias("rank"))
    return ranked.mapInArrow(_assign(sent), f"doc_id {doc_id}, piece int, start long, length long, ids_crc32 long{', ids array<int>' * with_ids}, sequence_id long, offset long")
