"""Connected components of a table of links, by alternating large and small stars.

Each round needs only least values by node (aggregated before the shuffle) and joins that can be split where a node is hot; no node's
neighbours are brought together. Every round's links are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b), b < a. Large: every node's larger neighbours go to its least one; small: its smaller ones and itself."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (of one orderable type). Returns node, root for each node with a link to another; root is the component's least node,
    which has a row of its own."""
    at = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state, settled = None, False
    while not settled:
        before, at = at, materialize(_stars(_stars(at, True), False), "links")
        discard(before)
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        settled, state = now == state, now
    nodes = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
