"""Names: ranked resolution, first-of-group rules, distinct with preference, whole words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_ranked(refs: DataFrame, ref_id: str, candidates: Sequence[DataFrame]) -> DataFrame:
    """refs with target and rank: candidates are tables (ref_id, target) in order of precedence; of the first that has any for a
    reference, its least target. One union and one aggregation, whatever the number of ranks."""
    union = None
    for rank, found in enumerate(candidates):
        own = found.select(ref_id, F.struct(F.lit(rank).alias("rank"), F.col("target").alias("target")).alias("_c"))
        union = own if union is None else union.unionByName(own)
    best = union.groupBy(ref_id).agg(F.min("_c").alias("_c"))
    return refs.join(best, ref_id, "left").select(refs["*"], F.col("_c.target").alias("target"), F.col("_c.rank").alias("rank"))


def unique_by(rows: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """keys and target where exactly one row has the keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(target).alias("target")).where("_n = 1").drop("_n")


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Of each group the columns keep of its first row in order; an aggregation, without a sort of the group."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *(x for x in keep if x not in order))).alias("_f")).select(*keys, *(F.col(f"_f.{x}").alias(x) for x in keep))


def more_than_one(rows: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Groups with several rows, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) > 1)


def whole_word(text: Column, word: str) -> Column:
    """word occurs in text between characters that can't belong to an identifier (ASCII letters, digits, _ and $)."""
    quoted = "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in word)
    return text.contains(word) & text.rlike(f"(?<![A-Za-z0-9_$]){quoted}(?![A-Za-z0-9_$])")


def matching(rows: DataFrame, kinds: Sequence[str] | None = None, kind: str = "kind", **patterns: str | None) -> DataFrame:
    """rows whose kind is listed (None: any) and whose columns match the unanchored patterns given."""
    if kinds is not None:
        rows = rows.where(F.col(kind).isin(list(kinds)) if kinds else F.lit(False))
    for column, pattern in patterns.items():
        if pattern:
            rows = rows.where(F.col(column).rlike(pattern))
    return rows
